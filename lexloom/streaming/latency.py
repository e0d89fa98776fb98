"""An extra beyond parity: running latency by stage over a stream of events, late data dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_latency(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Per window and stage: count, mean and approximate p50 and p95 of a stream (ts, event_type, value)."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("event_type").alias("stage"))
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.approx_percentile("value", [0.5, 0.95], 10_000).alias("p")).select(
        F.col("window.start").alias("start"), "stage", "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95")
    )
