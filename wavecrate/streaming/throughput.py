"""Counts of events by hour and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """(hour, event_type, n); a stream closes an hour once the watermark has passed it."""
    return _late(events, delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, event_type, n, total)."""
    out = _late(events, delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, event_type, n): counts of the seven days up to each day."""
    return _late(events, delay).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").cast("date").alias("day"), "event_type", "n")


def stale(samples: DataFrame, as_of: Column, hours: int = 2) -> DataFrame:
    """(stale, last): whether the sampler has been silent for too long."""
    return samples.agg(F.max("ts").alias("last")).select(F.coalesce(F.col("last") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(True)).alias("stale"), "last")
