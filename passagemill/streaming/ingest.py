"""An extension beyond batch: passages that arrive over time are scored, filtered and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def keep_informative(passages: DataFrame, least: float) -> DataFrame:
    """Streaming passages with distinct / all tokens of at least `least`: stateless, so no watermark."""
    t = tokens(F.col("text"))
    return passages.withColumn("quality", F.coalesce(F.try_divide(F.size(F.array_distinct(t)), F.size(t)), F.lit(0.0))).where(F.col("quality") >= least)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; state goes when the watermark passes a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
