"""Event streams: windows with late data, sessions, and copies delivered again. Each takes a streaming (or plain) DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, lateness: str) -> DataFrame:
    """Rows in tumbling windows of event time; rows later than `lateness` behind the newest one are left out of closed windows."""
    counted = events.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str, lateness: str) -> DataFrame:
    """Sessions of each key: runs of rows less than `gap` apart."""
    counted = events.withWatermark(time, lateness).groupBy(*by, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return counted.select(*by, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def without_copies(events: DataFrame, time: str, keys: list[str], lateness: str) -> DataFrame:
    """The first delivery of each key within the watermark; state is dropped behind it."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
