"""Windowed aggregates of event streams with watermarks; the same functions work on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_events(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``series_id, ts, value`` with a time zone, as watermarks need it."""
    return df.select(F.col(key).cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))


def tumbling(events: DataFrame, size: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count, mean and extremes of each window; events later than ``late`` behind the newest are dropped from streams."""
    src = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    t = src.groupBy(w.alias("w"), "series_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return t.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    src = events.withWatermark("ts", late) if late else events
    t = src.groupBy(F.session_window("ts", gap).alias("w"), "series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return t.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
