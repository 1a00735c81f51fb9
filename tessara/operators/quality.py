"""Guards, contracts, audits and drift alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data that breaks a stated contract."""


def unique_key(frame: DataFrame, key: list[str], what: str = "table") -> DataFrame:
    """``frame``, if its key is unique; checked before a join, so that a join can't fan out."""
    twice = frame.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ContractError(f"{what}: key {key} is not unique, e.g. {twice[0].asDict()}")
    return frame


def same_rows(before: DataFrame, after: DataFrame, what: str = "join") -> DataFrame:
    """``after``, if it has as many rows as ``before``."""
    a, b = before.count(), after.count()
    if a != b:
        raise ContractError(f"{what}: {a} rows became {b}")
    return after


def required(frame: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ContractError(f"{what}: columns {missing} are missing")
    return frame


def contract(frame: DataFrame, key: list[str], per: list[str], most: int, target: str) -> DataFrame:
    """One row: duplicate keys, groups with more than ``most`` rows, and rows without target, in three aggregates."""
    duplicates = frame.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    crowded = frame.groupBy(*per).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > most).alias("crowded_groups"))
    holes = frame.agg(F.count_if(F.col(target).isNull()).alias("null_targets"))
    return duplicates.join(F.broadcast(crowded)).join(F.broadcast(holes))  # one row each


def first_row_leaks(frame: DataFrame, entity: str, order: list[str], features: list[str]) -> DataFrame:
    """(feature, n): entities whose first row already has a trailing feature, which only later rows may have."""
    w = Window.partitionBy(entity).orderBy(*order)
    first = frame.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    one = first.agg(*[F.count(f).alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("n")) for f in features])))


def rebuilt(frame: DataFrame, entity: str, order: list[str], value: str, stored: str) -> DataFrame:
    """``frame`` with ``true_before`` and ``agrees``: the sum of a value over an entity's rows before, against a stored one."""
    before = F.coalesce(F.sum(value).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frame.withColumn("true_before", before).withColumn("agrees", F.col("true_before").eqNullSafe(F.col(stored)))


def spread(frame: DataFrame, entity: str, features: list[str]) -> DataFrame:
    """(feature, n, least, most, entities, constant): the range of each feature, and entities in which it never changes."""
    each = frame.groupBy(entity).agg(*[x for f in features for x in (F.count(f).alias(f"n_{f}"), F.min(f).alias(f"a_{f}"), F.max(f).alias(f"z_{f}"))])
    known = lambda f: F.col(f"n_{f}") > 1
    one = each.agg(*[x for f in features for x in (F.sum(f"n_{f}").alias(f"n_{f}"), F.min(f"a_{f}").alias(f"a_{f}"), F.max(f"z_{f}").alias(f"z_{f}"), F.count_if(known(f)).alias(f"e_{f}"), F.count_if(known(f) & (F.col(f"a_{f}") == F.col(f"z_{f}"))).alias(f"c_{f}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"a_{f}").cast("double").alias("least"), F.col(f"z_{f}").cast("double").alias("most"), F.col(f"e_{f}").alias("entities"), F.col(f"c_{f}").alias("constant")) for f in features])))


def drift(current: dict[str, float | None], baseline: dict[str, float | None], relative: dict[str, float], absolute: dict[str, float]) -> list[str]:
    """Names of metrics that moved too far from a stored baseline; a missing metric is an alarm."""
    out = []
    for name, most in relative.items():
        a, b = current.get(name), baseline.get(name)
        if a is None or b is None or (b != 0 and (a - b) / abs(b) > most):
            out.append(name)
    for name, most in absolute.items():
        a, b = current.get(name), baseline.get(name)
        if a is None or b is None or abs(a - b) > most:
            out.append(name)
    return out


def run_over_run(metrics: DataFrame, run: str, names: list[str]) -> DataFrame:
    """Metrics of each run with their change to the run before: a short history, one row for each run."""
    w = Window.orderBy(run)
    return metrics.select(run, *[c for n in names for c in (F.col(n), (F.col(n) - F.lag(n).over(w)).alias(f"{n}_change"))])


def classify(left: DataFrame, right: DataFrame, key: str, differs: Column) -> DataFrame:
    """(key, status): absent in the right table, there but different, or fine."""
    there = right.withColumn("__there", F.lit(True))
    both = left.join(there, key, "left")
    return both.select(key, F.when(F.col("__there").isNull(), "absent").when(differs, "different").otherwise("fine").alias("status"))


def steps(todo: list[tuple[str, object]]) -> list[tuple[str, bool, str]]:
    """Run steps in order, going on after a failure; (name, ok, message). The caller's mark moves only if all are ok."""
    out = []
    for name, step in todo:
        try:
            step()  # type: ignore[operator]
            out.append((name, True, ""))
        except Exception as error:  # reported, not hidden
            out.append((name, False, str(error)))
    return out
