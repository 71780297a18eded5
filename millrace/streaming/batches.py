"""Streams: documents in micro-batches, sessions of events, expiring conversations. An extension; all with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches, then stop; a restart goes on where the checkpoint is."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """With a watermark on streams, which takes times with a zone; batches keep the type they have."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(key, start, end, n_events): sessions that end after a gap; works on batches and streams alike."""
    e = _timed(events, at, late)
    s = e.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def counts_by_window(events: DataFrame, kind: str = "event_type", at: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    e = _timed(events, at, late)
    c = e.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n_events"))
    return c.select(F.col("w.start").alias("start"), kind, "n_events")
