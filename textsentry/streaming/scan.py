"""Scans of streams.  Row-wise results need no state; the rest is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.api import Engine


def scan_stream(stream: DataFrame, engine: Engine, text: str = "text") -> DataFrame:
    """The same columns as in batch; append mode, no state."""
    return engine.scan(stream, text)


def windowed(scanned: DataFrame, ts: str, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and detections by window and action; rows later than ``late`` are left out."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = scanned.withWatermark(ts, late).groupBy(window.alias("window"), *by, F.col("scan.action").alias("action"))
    return grouped.agg(F.count("*").alias("rows"), F.sum(F.size("scan.detections")).alias("detections")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "action", "rows", "detections")


def sessions(scanned: DataFrame, ts: str, user: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of each user with how many rows were denied."""
    grouped = scanned.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), user)
    return grouped.agg(F.count("*").alias("rows"), F.count_if(F.col("scan.action") == "deny").alias("denied")).select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), user, "rows", "denied")


def escalated(scanned: DataFrame, user: str, limit: int = 3, ts: str | None = None, size: str = "1 day", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Users with at least ``limit`` denied rows, without Python.

    With ``ts`` they are counted by window, and a window's counts are dropped
    once the watermark has passed it, so that the state is that of the open
    windows.  Without, the counts of all users are kept for ever: for batch, or
    streams of few users.
    """
    denied = F.count_if(F.col("scan.action") == "deny").alias("denied")
    who = F.col(user).cast("string").alias("user")
    if ts is None:
        return scanned.groupBy(who).agg(denied).where(F.col("denied") >= limit)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = scanned.withWatermark(ts, late).groupBy(window.alias("window"), who).agg(denied).where(F.col("denied") >= limit)
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "user", "denied")


def metrics(scanned: DataFrame, started: float | None = None) -> DataFrame:
    """One row of counters: scans, detections, denied rows and, given when the service began (seconds since 1970), its uptime."""
    up = F.lit(None).cast("double") if started is None else F.unix_micros(F.current_timestamp()) / 1e6 - F.lit(float(started))
    return scanned.agg(F.count(F.lit(1)).alias("scans_total"), F.coalesce(F.sum(F.size("scan.detections")), F.lit(0)).alias("detections_total"), F.count_if(~F.col("scan.is_safe")).alias("denied_total"), F.max(up).alias("uptime_seconds"))


def observed(scanned: DataFrame, name: str = "textsentry") -> DataFrame:
    """Counters of scans and detections, for listeners of batch and streaming queries."""
    return scanned.observe(name, F.count(F.lit(1)).alias("scans"), F.sum(F.size("scan.detections")).alias("detections"), F.count_if(~F.col("scan.is_safe")).alias("denied"))
