"""Event-time windows, alike for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events with ts as a timestamp under a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed(events: DataFrame, size: str, slide: str | None = None, *keys: str) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), *keys, "events", "cents")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    s = F.session_window("ts", gap)
    return events.groupBy(s.alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), "events")
