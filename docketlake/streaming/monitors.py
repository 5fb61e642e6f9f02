"""Streaming forms of some detectors: additions, with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.core import ten_thousandths


def daily_volume(stream: DataFrame, ts: str = "datetime", late: str = "1 day") -> DataFrame:
    """Messages per day; closed days are final."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


def long_days(stream: DataFrame, most: float = 10.0, late: str = "2 days") -> DataFrame:
    """Timekeepers whose hours of a day exceed ``most``, once the day is closed."""
    hours = stream.withWatermark("date", late).groupBy(F.window("date", "1 day"), "timekeeper").agg(F.sum(ten_thousandths(F.col("hours"))).alias("hours_e4"))
    return hours.filter(F.col("hours_e4") > most * 10_000).select(F.to_date("window.start").alias("day"), "timekeeper", "hours_e4")


def silences(stream: DataFrame, gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """Activity sessions per sender; the time after a session's end is a silence of ``gap`` at least."""
    s = stream.withWatermark("datetime", late).groupBy("sender", F.session_window("datetime", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("sender", F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("silent_by"), "n")
