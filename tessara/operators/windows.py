"""Leak-free window features: what was known before a row, never the row itself or a later one.

All functions are Column expressions over one window specification, so that any number of features of an entity share
one exchange and one sort. Order keys must be unique within an entity; give enough of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def history_of(by: str | list[str], *order: str | Column) -> WindowSpec:
    """An entity's rows in order of time."""
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)


def _rows(w: WindowSpec, n: int | None) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def prior_sum(value: Column, w: WindowSpec, n: int | None = None) -> Column:
    """Sum over the ``n`` rows before (all, without n); 0 where there are none."""
    return F.coalesce(F.sum(value).over(_rows(w, n)), F.lit(0))


def prior_mean(value: Column, w: WindowSpec, n: int | None = None) -> Column:
    """Mean over the ``n`` rows before (all, without n), nulls skipped; null where there are none.

    Integers are summed exactly and divided once.
    """
    over = _rows(w, n)
    return F.try_divide(F.sum(value).over(over).cast("double"), F.count(value).over(over).cast("double"))


def prior_ratio(top: Column, bottom: Column, w: WindowSpec, n: int | None = None) -> Column:
    """Ratio of two sums over the rows before; null where the lower one is 0 or missing."""
    over = _rows(w, n)
    return F.try_divide(F.sum(top).over(over).cast("double"), F.sum(bottom).over(over).cast("double"))


def forward_mean(value: Column, w: WindowSpec, n: int) -> Column:
    """Mean over this row and the ``n`` - 1 rows after it."""
    over = w.rowsBetween(0, n - 1)
    return F.try_divide(F.sum(value).over(over).cast("double"), F.count(value).over(over).cast("double"))


def days_since(day: Column, w: WindowSpec) -> Column:
    """Whole days since the entity's row before; null for its first."""
    return F.datediff(day, F.lag(day).over(w))


def step_or(value: Column, w: WindowSpec, first: int, unit: int = 1) -> Column:
    """Difference to the row before, or ``first`` where there is none, in units."""
    return F.coalesce(value - F.lag(value).over(w), F.lit(first)) * unit


def prior_streak(frame: DataFrame, flag: Column, by: str, order: list[str], out: str) -> DataFrame:
    """``frame`` with the number of rows directly before a row for which ``flag`` held (null counts as false)."""
    w = history_of(by, *order)
    held = F.coalesce(flag, F.lit(False)).cast("int")
    counted = frame.withColumn("__f", held).withColumn("__i", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum("__f").over(Window.partitionBy(by, "__i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("__s", run).withColumn(out, F.coalesce(F.lag("__s").over(w), F.lit(0))).drop("__f", "__i", "__s")


def latest_rows(frame: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in ``order``: an aggregate that combines on the map side, no window."""
    rest = [c for c in frame.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return frame.groupBy(*by).agg(last.alias("__x")).select(*by, "__x.*").select(*frame.columns)


def first_non_null(frame: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """For each key and column the first value in ``order`` that isn't null (one row may take them from several)."""
    return frame.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def top_n(frame: DataFrame, by: list[str], order: list[Column], n: int, number: str = "place") -> DataFrame:
    """The first ``n`` rows of each key with their place; ties are broken by the later order keys."""
    return frame.withColumn(number, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(number) <= n)


def nested_top_n(frame: DataFrame, by: list[str], order: list[Column], n: int, fields: list[str], out: str) -> DataFrame:
    """One row for each key with an array of its first ``n`` records."""
    kept = top_n(frame, by, order, n, "__p")
    records = F.array_sort(F.collect_list(F.struct("__p", *fields)))
    return kept.groupBy(*by).agg(F.transform(records, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(out))


def duplicate_flags(frame: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``frame`` with ``is_duplicate`` (the key has several rows) and ``is_kept`` (the first of them in order)."""
    w = Window.partitionBy(*by)
    return frame.withColumns({"is_duplicate": F.count("*").over(w) > 1, "is_kept": F.row_number().over(w.orderBy(*order)) == 1})
