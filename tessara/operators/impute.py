"""Filling missing figures from similar rows, by k-prototypes clusters.

Rows are clustered on what was observed of them: standardised numbers (missing ones add nothing to a distance) and
categories (a mismatch costs ``gamma``). A missing figure is filled with its cluster's median or mode; where the cluster
has too few observed figures, with that of the parent group, then of all rows. Each filled value carries its method.

Scale: each round of fitting is one pass in which a task sums its own rows to k short ones (matrix products over Arrow
batches: an eighth of the time of the same sums as Column expressions), so what is exchanged doesn't grow with the data;
the centers are k short rows on the driver. Rounds go on until the centers stand still. Medians are mergeable quantile
summaries, so no group is ever gathered in one task; the table of fills has (k + groups + 1) rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.operators.relate import small_lookup
from tessara.session import checkpoint_dir, ship

#: Values that a categorical feature may have; it is an error to cluster on one with more.
MOST_KINDS = 1000
#: Rounds stop when they lower the total distance by less than this share, and are an error beyond ``MOST_ROUNDS``.
STILL, MOST_ROUNDS = 1e-4, 200


class NotConverged(RuntimeError):
    """The centers still moved after as many rounds as were allowed."""


@dataclass(frozen=True)
class Prototypes:
    """Fitted centers: standardised numbers and categories; None matches nothing and has no distance."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    mean: dict[str, float]
    scale: dict[str, float]
    centers: tuple[dict, ...]
    gamma: float
    rounds: int = 0

    def nearest(self, numbers: np.ndarray, categories: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest center, its distance, standardised numbers with 0 for missing ones, what is observed).

        Of sum over observed j of ((x_j - c_j) / s_j)^2 the part without c is the same for all centers and left out; a
        categorical match takes ``gamma`` off. Ties go to the lower index.
        """
        seen = ~np.isnan(numbers)
        z = np.where(seen, (numbers - [self.mean[n] for n in self.numeric]) / [self.scale[n] for n in self.numeric], 0.0)
        c = np.array([[x[n] if x[n] is not None else 0.0 for n in self.numeric] for x in self.centers]).reshape(len(self.centers), len(self.numeric))
        distance = seen.astype(float) @ (c**2).T - 2 * z @ c.T
        for n, values in zip(self.categorical, categories):
            for k, x in enumerate(self.centers):
                if x[n] is not None:
                    distance[:, k] -= self.gamma * (values == x[n])
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(best)), best], z, seen

    def assign(self, frame: DataFrame, out: str = "__k") -> DataFrame:
        """``frame`` with the index of each row's nearest center; 0 without centers. Only the features go to Python."""
        if len(self.centers) < 2:
            return frame.withColumn(out, F.lit(0))
        ship(frame.sparkSession)
        n = len(self.numeric)

        @F.pandas_udf("int")
        def index(*features: pd.Series) -> pd.Series:
            numbers = np.column_stack([x.to_numpy(dtype=float, na_value=np.nan) for x in features[:n]]) if n else np.empty((len(features[0]), 0))
            return pd.Series(self.nearest(numbers, [x.to_numpy(dtype=object) for x in features[n:]])[0].astype("int32"))

        return frame.withColumn(out, index(*[F.col(x).cast("double") for x in self.numeric], *[F.col(x).cast("string") for x in self.categorical]))


def _first_centers(rows: DataFrame, names: list[str], k: int, seed: int) -> list:
    """k different rows, whatever the partitioning: of those that share some bits of a hash the least, then the least k."""
    h = F.xxhash64(F.lit(seed), *names)
    least = rows.groupBy(F.pmod(h, F.lit(64 * k)).alias("__b")).agg(F.min(F.struct(h.alias("__h"), *names)).alias("x"))
    return least.orderBy("x").limit(k).select("x.*").collect()


def fit_prototypes(frame: DataFrame, numeric: list[str], categorical: list[str], k: int = 12, gamma: float = 1.0, seed: int = 7, rounds: int = MOST_ROUNDS) -> Prototypes:
    """K-prototypes over all rows, until the centers stand still; ``NotConverged`` if they don't within ``rounds``.

    A categorical feature has at most ``MOST_KINDS`` values. An empty frame gives no centers (one cluster for all); a
    feature without spread gets the scale 1; a center's category is the most frequent one (ties: the least).
    """
    spread = frame.agg(F.count("*").alias("n"), *[F.approx_count_distinct(n).alias(f"c_{n}") for n in categorical], *[x for n in numeric for x in (F.avg(F.col(n).cast("double")).alias(f"m_{n}"), F.stddev_pop(F.col(n).cast("double")).alias(f"s_{n}"))]).first()
    wide = [n for n in categorical if spread[f"c_{n}"] > MOST_KINDS]
    if wide:
        raise ValueError(f"{wide}: more than {MOST_KINDS} values are no categories")
    mean = {n: float(spread[f"m_{n}"] or 0.0) for n in numeric}
    scale = {n: float(spread[f"s_{n}"] or 1.0) for n in numeric}
    names = [*numeric, *categorical]
    rows = frame.select(*[F.col(n).cast("double").alias(n) for n in numeric], *[F.col(n).cast("string").alias(n) for n in categorical])
    standard = lambda n, x: None if x is None else (float(x) - mean[n]) / scale[n]
    centers = tuple({n: standard(n, r[n]) if n in mean else r[n] for n in names} for r in (_first_centers(rows, names, k, seed) if spread["n"] else []))
    fitted = Prototypes(tuple(numeric), tuple(categorical), mean, scale, centers, gamma)
    if len(centers) < 2:
        return fitted
    ship(frame.sparkSession)
    before = None
    for number in range(1, rounds + 1):
        moved, total = _moved(rows, fitted)
        fitted = Prototypes(fitted.numeric, fitted.categorical, mean, scale, moved, gamma, number)
        if before is not None and before - total <= STILL * abs(before):
            return fitted
        before = total
    raise NotConverged(f"centers still move after {rounds} rounds")


def _moved(rows: DataFrame, fitted: Prototypes) -> tuple[tuple[dict, ...], float]:
    """The centers of the rows nearest to each old one, and the total distance to the old ones."""
    n, k = len(fitted.numeric), len(fitted.centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str, str], float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(n)]) if n else np.empty((batch.num_rows, 0))
            categories = [batch.column(n + j).to_numpy(zero_copy_only=False) for j in range(len(fitted.categorical))]
            best, distance, z, seen = fitted.nearest(numbers, categories)
            of = np.eye(k)[best]  # (rows, k)
            inertia = distance + (z**2).sum(axis=1) + fitted.gamma * len(categories)
            parts = {("d", ""): of.T @ inertia} | {("s", fitted.numeric[j]): of.T @ z[:, j] for j in range(n)} | {("n", fitted.numeric[j]): of.T @ seen[:, j] for j in range(n)}
            for name, values in zip(fitted.categorical, categories):
                for value in {x for x in values if x is not None}:
                    parts["c" + name, value] = of.T @ (values == value)
            for (what, name), each in parts.items():
                for c in np.flatnonzero(each):
                    sums[int(c), what, name] = sums.get((int(c), what, name), 0.0) + float(each[c])
        if sums:
            c, what, name = zip(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(what), pa.array(name), pa.array(list(sums.values()), pa.float64())], names=["k", "what", "name", "v"])

    found = rows.mapInArrow(run, "k int, what string, name string, v double").groupBy("k", "what", "name").agg(F.sum("v").alias("v")).collect()
    sums = {(r["k"], r["what"], r["name"]): r["v"] for r in found}
    kinds: dict[tuple[int, str], list[tuple[float, str]]] = {}
    for (c, what, name), v in sums.items():
        if what[0] == "c":
            kinds.setdefault((c, what[1:]), []).append((-v, name))
    centers = []
    for c, old in enumerate(fitted.centers):
        if (c, "d", "") not in sums and not any((c, "n", x) in sums for x in fitted.numeric) and not any((c, x) in kinds for x in fitted.categorical):
            centers.append(old)
            continue
        mean_of = lambda x: sums.get((c, "s", x), 0.0) / sums[c, "n", x] if sums.get((c, "n", x)) else None  # noqa: E731, B023
        centers.append({x: mean_of(x) for x in fitted.numeric} | {x: min(kinds[c, x])[1] if (c, x) in kinds else None for x in fitted.categorical})
    return tuple(centers), sum(v for (_, what, _), v in sums.items() if what == "d")


def fill_from_similar(frame: DataFrame, fields: dict[str, tuple[Column, str]], wanted: Column, numeric: list[str], categorical: list[str], parent: str, k: int = 12, least: int = 5) -> DataFrame:
    """``frame`` with ``filled_<field>`` and ``method_<field>`` for each field.

    ``fields``: for each a condition under which its figure is valid (null counts as not valid), and ``median`` or
    ``mode``. ``wanted``: the rows that ought to have figures; others keep what they have and get no mark.
    ``method_<field>``: null where nothing was filled, else cluster, parent, global or none (there was nothing to fill
    from; the value stays null). Every row comes back once, with its other columns whatever their names; existing columns
    ``filled_<field>`` and ``method_<field>`` are replaced.
    """
    frame = frame.drop(*[f"{x}_{f}" for f in fields for x in ("filled", "method")])
    wanted = F.coalesce(wanted, F.lit(False))
    valid = {f: F.coalesce(ok, F.lit(False)) & F.col(f).isNotNull() for f, (ok, _) in fields.items()}
    rows = frame.withColumns({"__want": wanted, **{f"__v_{f}": F.when(v, F.col(f).cast("double")) for f, v in valid.items()}})
    fitted = fit_prototypes(rows.where("__want"), numeric, categorical, k)
    rows = fitted.assign(rows)
    figures = []
    for f, (_, how) in fields.items():
        middle = F.percentile_approx(f"__v_{f}", 0.5, 10000) if how == "median" else F.mode(f"__v_{f}", True)
        figures += [middle.alias(f"__x_{f}"), F.count(f"__v_{f}").alias(f"__n_{f}")]
    # one pass for the three levels: k rows, one for each parent group, and one
    levels = rows.where("__want").withColumn("__pk", F.col(parent).cast("string")).groupingSets([["__k"], ["__pk"], []], "__k", "__pk").agg(F.grouping_id().alias("__level"), *figures)
    checkpoint_dir(frame.sparkSession)
    levels = levels.checkpoint()
    named = lambda level, mark: levels.where(F.col("__level") == level).select(*([F.col("__k").alias("__ck")] if mark == "c" else [F.col("__pk").alias("__pp")] if mark == "p" else []), *[F.col(f"__{x}_{f}").alias(f"__{mark}{x}_{f}") for f in fields for x in "xn"])
    by_cluster, by_parent, overall = named(1, "c"), named(2, "p"), named(3, "g")
    # k rows and one row; parent groups may be many, and are broadcast only if they are counted as few
    out = rows.join(F.broadcast(by_cluster), rows["__k"] == by_cluster["__ck"], "left").join(F.broadcast(overall), F.lit(True), "left").withColumn("__pk", F.col(parent).cast("string"))
    out = small_lookup(out, by_parent.withColumnRenamed("__pp", "__pk"), ["__pk"], "left")
    added = {}
    for f in fields:
        lacking = F.col("__want") & F.col(f"__v_{f}").isNull()
        by = [(F.coalesce(F.col(f"__{x}n_{f}"), F.lit(0)) >= n, F.col(f"__{x}x_{f}"), name) for x, n, name in (("c", least, "cluster"), ("p", least, "parent"), ("g", 1, "global"))]
        value, method = F.lit(None).cast("double"), F.lit("none")
        for enough, middle, name in reversed(by):
            value, method = F.when(enough, middle).otherwise(value), F.when(enough, F.lit(name)).otherwise(method)
        added[f"filled_{f}"] = F.when(lacking, value).otherwise(F.col(f).cast("double"))
        added[f"method_{f}"] = F.when(lacking, method)
    return out.select(*[rows[c] for c in frame.columns], *[c.alias(n) for n, c in added.items()])
