"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a folder, only the given columns if any; NaN in doubles becomes NULL.

    The select comes first, so the scan's ReadSchema holds just these columns.
    """
    frame = spark.read.parquet(f"{root}/{name}.parquet")
    if columns:
        frame = frame.select(*columns)
    return nan_to_null(frame)


def nan_to_null(frame: DataFrame) -> DataFrame:
    """Missing figures have one form, NULL (a NaN would poison sums and averages)."""
    floats = [n for n, kind in frame.dtypes if kind in ("double", "float")]
    return frame.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else frame


def present(frame: DataFrame, names: list[str]) -> list[str]:
    """Those of the names that the frame has, in the order asked for."""
    have = set(frame.columns)
    return [n for n in names if n in have]


def adapt(frame: DataFrame, conventions: list[dict[str, str]]) -> DataFrame:
    """``frame`` with the names of the first convention (old name -> new name) whose old names it all has."""
    for names in conventions:
        if set(names) <= set(frame.columns):
            return frame.withColumnsRenamed(names)
    raise ValueError(f"columns {frame.columns} follow no known convention")


def rounded(frame: DataFrame, digits: int) -> DataFrame:
    """All fractional columns rounded."""
    return frame.withColumns({n: F.round(n, digits) for n, kind in frame.dtypes if kind in ("double", "float")})
