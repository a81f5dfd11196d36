"""Tumbling days and sliding weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(domain: str, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("domain") == domain, value)), F.lit(0))


def _usb(events: DataFrame) -> Column:
    """1 for a device connection, 0 otherwise and where the stream has no activities."""
    if "activity" not in events.columns:
        return F.lit(0)
    return F.coalesce((F.lower("activity") == "connect").cast("bigint"), F.lit(0))


def stream_daily(events: DataFrame) -> DataFrame:
    """User-days in append mode; rows older than the watermark are left out.

    Two aggregations in a row: first per (user, domain, machine), which spreads a busy user
    and makes the number of distinct machines exact, then per user.
    """
    ah = F.col("after_hours").cast("bigint")
    usb = _usb(events)
    leak = F.lit(0)
    if "is_wikileaks" in events.columns:
        leak = F.coalesce(F.col("is_wikileaks").cast("bigint"), F.lit(0))
    per_pc = events.groupBy(F.window("ts", "1 day"), "user_key", "domain", "pc").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ah).alias("ah"),
        F.sum(usb).alias("usb"),
        F.sum(leak).alias("leak"),
    )
    per_user = per_pc.groupBy(F.window(F.window_time("window"), "1 day"), "user_key").agg(
        _of("logon", F.col("n")).alias("n_logon"),
        _of("device", F.col("n")).alias("n_device_events"),
        _of("file", F.col("n")).alias("n_file_events"),
        _of("http", F.col("n")).alias("n_http"),
        _of("email", F.col("n")).alias("n_email_sent"),
        _of("logon", (F.col("pc").isNotNull()).cast("bigint")).alias("n_pc_used"),
        _of("device", F.col("usb")).alias("n_usb_connects"),
        _of("http", F.col("leak")).alias("n_wikileaks"),
        F.sum("ah").alias("n_after_hours"),
        F.sum("n").alias("n_events"),
    )
    return per_user.select(
        "user_key", F.col("window.start").cast("date").alias("day"), F.window_time("window").alias("ts"),
        *[c for c in per_user.columns if c not in ("window", "user_key")],
    )


def stream_trend(events: DataFrame, days: int = 7) -> DataFrame:
    """Counts over the last `days` days, moving by one."""
    usb = _usb(events)
    out = events.groupBy(F.window("ts", f"{days} days", "1 day"), "user_key").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col("after_hours").cast("bigint")).alias("n_after_hours"),
        F.sum(usb).alias("n_usb_connects"),
    )
    return out.select(
        "user_key",
        F.col("window.start").cast("date").alias("first_day"),
        F.date_sub(F.col("window.end").cast("date"), 1).alias("last_day"),
        "n_events", "n_after_hours", "n_usb_connects",
    )
