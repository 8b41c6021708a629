"""Event-time aggregation over a stream of events; the same functions work on batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type and window of ``ts``; rows later than ``late`` are dropped on a stream."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = seen.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per user and session, a session ending after ``gap`` without events."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = seen.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, by its id, while the watermark remembers it."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else seen.dropDuplicates(["event_id"])
