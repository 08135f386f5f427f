"""Structured Streaming: file ingestion, event-time windows, session costs, orphan deltas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.orphans import OrphanStore, references


def read_events(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A file stream of events; watermarks need a zoned timestamp, so ``ts`` is cast."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    stream = stream.parquet(path) if os.path.isdir(path) else stream.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; works on streams and on tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    agg = marked.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Visits of a user: runs of events with gaps below ``gap``."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    agg = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return agg.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", "total")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the file source remembers what it has read."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def orphan_stream(store: OrphanStore, stream: DataFrame, rows, checkpoint: str) -> None:
    """Feed what a stream has into a store of references, then stop.

    ``rows``: ``references``, ``entity_parents`` or ``chunk_parents``; a batch that is run
    again after a failure has the same number, and the store knows it.
    """
    side = "refs" if rows is references else "parents"
    feed = lambda df, n: store.apply(**{side: rows(df)}, batch=f"{rows.__name__}-{n}") and None
    stream.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
