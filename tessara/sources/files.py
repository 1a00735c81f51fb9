"""Sources: delimited, JSON, HTML, logs and plain lists, with declared schemas and no inference; incremental reading."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessara.sources.tables import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header and a declared schema; unreadable values become null."""
    frame = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="PERMISSIVE", nullValue="")
    return nan_to_null(frame.select(*columns) if columns else frame)


def read_nested_json(spark: SparkSession, path: str, schema: str, explode: str | None = None, prefix: str = "", lines: bool = False) -> DataFrame:
    """JSON documents; ``explode`` names an array whose elements become rows beside the document's other fields.

    A file is one document, or with ``lines`` a document on each line. Documents that do not fit the schema are left out
    here; ``corrupt_documents`` and ``corrupt_records`` give them.
    """
    kind = T._parse_datatype_string(schema)
    frame = spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE", multiLine=not lines)
    frame = frame.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if explode:
        rest = [c for c in frame.columns if c != explode]
        inner = [f.name for f in frame.schema[explode].dataType.elementType.fields]
        frame = frame.select(*rest, F.explode(explode).alias("__x")).select(*rest, *[F.col(f"__x.{n}").alias(f"{prefix}{n}") for n in inner])
    return frame


def corrupt_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, raw): the JSON documents that ``read_nested_json`` leaves out, kept as they are."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return _unfit(texts, schema).select("file", F.col("value").alias("raw"))


def _unfit(texts: DataFrame, schema: str) -> DataFrame:
    """Those of the texts in ``value`` that are empty or do not fit the schema."""
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # a generator is a border: the parser would leave out a column that only a filter reads
    rows = texts.select("*", F.explode(F.array(parsed)).alias("x"))
    return rows.where(F.col("x._corrupt").isNotNull() | (F.trim("value") == "")).drop("x")


def corrupt_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(raw): lines of a JSON-lines file that do not fit the schema, kept as they are."""
    return _unfit(spark.read.text(path), schema).select(F.col("value").alias("raw"))


def flatten(frame: DataFrame, separator: str = "_") -> DataFrame:
    """Struct fields as columns named outer_inner, at any depth."""
    out, again = [], False
    for field in frame.schema.fields:
        if isinstance(field.dataType, T.StructType):
            again = True
            out += [F.col(f"`{field.name}`.`{x.name}`").alias(f"{field.name}{separator}{x.name}") for x in field.dataType.fields]
        else:
            out.append(F.col(f"`{field.name}`"))
    frame = frame.select(*out)
    return flatten(frame, separator) if again else frame


def read_pages(spark: SparkSession, folder: str, glob: str, numbers: dict[str, str], counts: dict[str, str]) -> DataFrame:
    """(page_id, numbers, counts) of HTML files: the page's id is its file's stem.

    ``numbers``: column -> pattern whose first group is a number (null without a match); ``counts``: column -> text to
    count. Patterns run natively; no page leaves the JVM.
    """
    pages = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    found = [F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast("double").alias(n) for n, p in numbers.items()]
    counted = [F.regexp_count("value", F.lit(p)).cast("bigint").alias(n) for n, p in counts.items()]
    return pages.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("page_id"), *found, *counted)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): the lines of a plain text, trimmed, empty ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where(F.length("name") > 0)


def read_log(spark: SparkSession, folder: str, fields: dict[str, str], glob: str = "*.log") -> DataFrame:
    """(file, fields): numbers that patterns find in whole log files; the last match counts."""
    logs = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    last = lambda p: F.element_at(F.regexp_extract_all("value", F.lit(p), F.lit(1)), -1)
    return logs.select("file", *[F.when(F.col("value").rlike(p), last(p)).try_cast("double").alias(n) for n, p in fields.items()])


def latest_file(frame: DataFrame) -> DataFrame:
    """The rows of the file that comes last by name (a frame with a ``file`` column)."""
    return frame.join(F.broadcast(frame.agg(F.max("file").alias("file"))), "file", "left_semi")


def unseen(source: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet: the resume of an incremental pull."""
    return source.join(stored.select(key).distinct(), key, "left_anti")


def read_state(path: str, default: dict) -> dict:
    """A small JSON state, or the default."""
    file = Path(path)
    return json.loads(file.read_text()) if file.exists() else dict(default)
