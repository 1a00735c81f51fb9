"""Sinks that don't lose good data: guarded overwrite, append where the first write wins, side outputs, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.operators.quality import run_over_run
from tessara.operators.relate import first_write_wins


class EmptyResult(ValueError):
    """A result without rows, which must not replace anything."""


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Swap a finished folder in, by the file system's own rename (any Hadoop file system, not only a local one)."""
    jvm = spark.sparkContext._jvm
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (target, source, target.rstrip("/") + ".old"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        raise OSError(f"cannot move {source} to {target}")
    fs.delete(aside, True)


def guarded_overwrite(frame: DataFrame, path: str, kind: str = "parquet", least: int = 1) -> int:
    """Write beside, count what was written, swap only if there are enough rows; returns their number.

    The result is computed once: rows are counted from what was written.
    """
    spark, beside = frame.sparkSession, path.rstrip("/") + ".new"
    writer = frame.write.mode("overwrite").format(kind)
    (writer.option("header", True) if kind == "csv" else writer).save(beside)
    reader = spark.read.format(kind).schema(frame.schema)
    n = (reader.option("header", True) if kind == "csv" else reader).load(beside).count()
    if n < least:
        raise EmptyResult(f"{n} rows for {path}; what was there stays")
    _move(spark, beside, path)
    return n


def append_first_wins(update: DataFrame, path: str, key: list[str], order: list[str]) -> int:
    """Merge an update into a stored history whose rows are never replaced."""
    spark = update.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    history = spark.read.parquet(path) if there else update.limit(0)
    return guarded_overwrite(first_write_wins(history, update, key, order), path)


def split_duplicates(flagged: DataFrame, path: str) -> DataFrame:
    """Write the rows that are duplicates and not kept to a side output; return those that are kept."""
    flagged.where("is_duplicate and not is_kept").drop("is_duplicate", "is_kept").write.mode("overwrite").parquet(path)
    return flagged.where("is_kept").drop("is_duplicate", "is_kept")


def write_state(path: str, state: dict) -> None:
    """A small JSON state, replaced in one step."""
    beside = Path(path + ".new")
    beside.write_text(json.dumps(state, sort_keys=True))
    beside.replace(path)


def report_page(frame: DataFrame, template: str, mark: str = "__DATA__", most: int = 5000) -> str:
    """A page with a report's rows as JSON. A report is small: more than ``most`` rows are an error, not a cut."""
    rows = frame.select(F.to_json(F.struct("*")).alias("x")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return template.replace(mark, "[" + ",".join(r["x"] for r in rows) + "]")


def text_report(frame: DataFrame, title: str, most: int = 200) -> str:
    """A small report as plain text: a title, a line of names and a line for each row, in columns.

    More than ``most`` rows are an error, not a cut. Nulls are shown as a dash.
    """
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cells = [list(frame.columns)] + [["-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r] for r in rows]
    widths = [max(map(len, column)) for column in zip(*cells)]
    lines = ["  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in cells]
    return "\n".join([title, *lines]) + "\n"


def report_run(metrics: DataFrame, path: str, run: str, names: list[str], title: str) -> str:
    """Add a run's metrics to a stored history, whose rows are never replaced, and report all runs with their changes."""
    append_first_wins(metrics, path, [run], names)
    return text_report(run_over_run(metrics.sparkSession.read.parquet(path), run, names).orderBy(run), title)
