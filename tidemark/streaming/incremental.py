"""Incremental and streaming runs (I1-I7, I10): file streams with checkpoints, keyed merges per batch,
event-time windows, and change detection by tracked columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import latest
from ..sources import versions


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder; the checkpoint of the query is the frontier."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merging(table: str, keys: list[str], order: list[Column], name: str):
    """A sink that keeps the first row per key under ``order``, of a batch and of what the versioned table
    holds. The table remembers the batch's number: one that comes again, after a failure or by mistake,
    changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        versions.merge_into(batch.sparkSession, table, latest(batch, keys, order) if order else batch, keys, batch=(name, number), order=order or None)

    return put


def merge_stream(stream: DataFrame, table: str, keys: list[str], order: list[Column], checkpoint: str, name: str = "stream") -> StreamingQuery:
    """All that has arrived, merged batch by batch, then stop; the checkpoint is the frontier, so the
    next call goes on where this one ended, with the state it had. Without ``order`` the rows of a batch have
    different keys already."""
    return stream.writeStream.foreachBatch(merging(table, keys, order, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts per event-time window and key; rows later than ``late`` are dropped, on a stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def changed_since(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """I4."""
    return df.where(F.col(column) > F.lit(cutoff).cast("timestamp"))


def tracked_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stale(now: DataFrame, done: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """Rows never done, or done with other values in the tracked columns; ``done`` has (keys, mark)."""
    return now.withColumn("mark", tracked_hash(*tracked)).join(done.select(*keys, "mark"), [*keys, "mark"], "left_anti")


def since_run(log: DataFrame, last_run: str | None, base: str = "backfill") -> DataFrame:
    """Increments after a run; without one, the base and all increments."""
    return log if last_run is None else log.where((F.col("run_id") > last_run) & (F.col("ingest_mode") != base))


def frontier(state: DataFrame, key: str) -> DataFrame:
    """The last saved value of a key."""
    return state.where(F.col("state_key") == key).agg(F.max_by("state_value", "updated_at").alias("state_value"))
