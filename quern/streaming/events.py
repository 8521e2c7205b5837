"""Trends and sessions over a stream of events, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events, value and users by tumbling window and type; users are estimated, as state must stay bounded."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"), F.approx_count_distinct("user_id").alias("users"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "value", "users")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user: runs of events less than `gap` apart."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")
    )


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once, however often it arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
