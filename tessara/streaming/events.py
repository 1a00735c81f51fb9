"""Streaming: high-water mark, windowed counts with a watermark, deduplication, the last values of a user as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessara.session import ship



def event_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The event files of a folder as a stream, or a single file, with the schema of what is there."""
    kind = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    # a file stream watches folders
    reader = spark.readStream.schema(kind).option("maxFilesPerTrigger", per_trigger)
    reader = reader if folder else reader.option("pathGlobFilter", at.getName())
    return reader.parquet(path if folder else str(at.getParent())).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and total (in hundredths) of each event type in tumbling windows; events later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark: the state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def last_values(events: DataFrame, keep: int = 5, idle: str = "90 days") -> DataFrame:
    """(user_id, n, mean_last): after each batch the mean of a user's last ``keep`` values, by time then id.

    A user's state is ``keep`` values, and is dropped when the stream has gone on for ``idle`` after the user's last
    event, so that state doesn't grow with all users ever seen. Events later than that are dropped.
    """
    ship(events.sparkSession)
    kept_for = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [pd.DataFrame(dict(zip(("ts", "event_id", "value"), state.get)))] if state.exists else []
        for batch in batches:
            new = batch[["ts", "event_id", "value"]].dropna(subset=["value"])
            if len(new):
                parts.append(new.assign(ts=new["ts"].astype("datetime64[us]").astype("int64")))
                parts = [pd.concat(parts, ignore_index=True).sort_values(["ts", "event_id"]).tail(keep)]
        if parts:
            held = parts[0]
            state.update((held["ts"].astype("int64").tolist(), held["event_id"].astype("int64").tolist(), held["value"].astype(float).tolist()))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(held["ts"].max()) // 1000) + kept_for)
            yield pd.DataFrame({"user_id": [key[0]], "n": [len(held)], "mean_last": [float(held["value"].mean())]})

    return events.withWatermark("ts", idle).groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, mean_last double", "ts array<long>, id array<long>, value array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def newly_completed(rounds: DataFrame, last: int) -> int | None:
    """The first round after the mark that is finished and checked; None if there is none.

    The caller moves the mark only when every step for that round succeeded.
    """
    row = rounds.where((F.col("id") > last) & F.col("finished") & F.col("data_checked")).agg(F.min("id").alias("id")).first()
    return None if row is None else row["id"]


def run_available(frame: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that is there, then stop; what it wrote, with the number of the batch that did.

    Each batch is written to its own folder, again if the batch is repeated, so that nothing counts twice; in complete
    mode the last batch holds the whole result. Nothing goes through the driver. ``folder`` must be shared.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run_changes(frame, write, f"{folder}/state", mode)
    spark = frame.sparkSession
    out = spark.read.option("basePath", f"{folder}/out").schema(T.StructType([*frame.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    return out


def run_changes(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> None:  # noqa: ANN001
    """Feed each micro-batch to ``apply(frame, number)``: a change feed between snapshots, exactly once per batch number."""
    stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
