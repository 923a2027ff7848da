"""Event streams: the gate and sinks of batch use over Structured Streaming file sources.

An extension: what the engine replaces only appends events and pulls by a high-water mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "id string, user_id string, event string, payload string, created_at timestamp"
#: Fixed value: what an event may be called.
EVENT_NAME = "^[a-z][a-z0-9_]{1,31}$"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def gate(events: DataFrame) -> DataFrame:
    """Only well-named events pass."""
    return events.where(F.col("event").rlike(EVENT_NAME))


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only sink; each event once by its id within the watermark."""
    once = gate(events).withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by name and window, late rows up to the watermark counted."""
    return gate(events).withWatermark("created_at", late).groupBy(F.window("created_at", window), "event").agg(F.count(F.lit(1)).alias("n"))


def segments_at(positions: DataFrame, segments: DataFrame, path: str, checkpoint: str, width: int = 4096) -> StreamingQuery:
    """Playback positions (track_id, at_ms) as a stream, each with the verse of its half-open segment (null without one), at ``path``.

    Each micro-batch meets the segments by ``interval_lookup``: an equi-join on track and cell, so the cells of a hot
    track go to different tasks. A batch writes its own folder and replaces it when it is run again after a failure.
    """
    from textloom.operators.progress import interval_lookup

    def place(batch: DataFrame, number: int) -> None:
        interval_lookup(batch, segments, "track_id", "at_ms", "start_ms", "end_ms", width).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return positions.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
