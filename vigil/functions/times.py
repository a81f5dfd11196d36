"""Timestamps, months, working hours and employment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log format first, then formats tried for rows that do not match it.
LOG_FORMAT = "MM/dd/yyyy HH:mm:ss"
FLEXIBLE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "yyyy-MM-dd")


def parse_ts(c: Column, formats: Sequence[str] = (LOG_FORMAT, *FLEXIBLE_FORMATS)) -> Column:
    """First format that parses, row by row; NULL where none does. No time zone."""
    tries = [F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def day(ts: Column) -> Column:
    return ts.cast("date")


def after_hours(ts: Column, start: int = 7, end: int = 19) -> Column:
    return F.coalesce((F.hour(ts) < start) | (F.hour(ts) >= end), F.lit(False))


def business_hours(ts: Column, start: int = 7, end: int = 19) -> Column:
    return F.coalesce((F.hour(ts) >= start) & (F.hour(ts) < end), F.lit(False))


def is_active(month: Column, first_seen: Column, last_seen: Column) -> Column:
    return F.coalesce(month.between(first_seen, last_seen), F.lit(False))


def join_reason(month: Column, first_seen: Column, last_seen: Column) -> Column:
    return (
        F.when(first_seen.isNull(), "not_in_ldap")
        .when(month < first_seen, "pre_hire")
        .when(month > last_seen, "post_departure")
        .otherwise("matched")
    )
