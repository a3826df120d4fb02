"""Structured Streaming over sensor-like events; an extension, with no counterpart to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_health(events: DataFrame, minutes: int = 10, late: str = "30 minutes", degraded: float = 40.0, critical: float = 20.0) -> DataFrame:
    """Mean value by event type and window with its state; rows later than ``late`` are dropped by the watermark.

    Works on a stream and on a batch table; repeated ``event_id`` within the watermark count once on a stream.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    if e.isStreaming:
        e = e.dropDuplicatesWithinWatermark(["event_id"])
    g = e.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    state = F.when(F.col("mean_value") < critical, "CRITICAL").when(F.col("mean_value") < degraded, "DEGRADED").otherwise("OK")
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean_value", state.alias("state"))
