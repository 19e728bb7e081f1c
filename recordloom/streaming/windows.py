"""Windowed counts of event streams; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, ts: str = "ts", size: str = "1 hour", by: tuple[str, ...] = ("event_type",), value: str = "value", late: str | None = "10 minutes") -> DataFrame:
    """Count and sum per window and key."""
    g = _marked(events, ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total")


def sliding(events: DataFrame, ts: str = "ts", size: str = "1 hour", step: str = "30 minutes", by: tuple[str, ...] = ("event_type",), late: str | None = "10 minutes") -> DataFrame:
    g = _marked(events, ts, late).groupBy(F.window(ts, size, step), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", by: tuple[str, ...] = ("user_id",), late: str | None = "10 minutes") -> DataFrame:
    """Runs of events of a key with no pause as long as ``gap``."""
    g = _marked(events, ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")
