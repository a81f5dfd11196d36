"""Forecast watch windows: opened by a strong forecast, resolved by an escalation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scoring import WATCH_HORIZON, WATCH_THRESHOLD

WATCH_SCHEMA = (
    "user_key string, start_day date, expiry_day date, max_score double, resolved boolean, "
    "escalation_day date, lead_time_days int"
)


#: The columns of the alerts that `watch_days` reads.
WATCHED = ("user_key", "day", "detector_rank", "forecast_score", "escalated")


@dataclass
class Watch:
    """The window that is open for a user."""

    start: dt.date
    expiry: dt.date
    max_score: float
    escalation: dt.date | None = None

    def row(self, user: str) -> tuple:
        lead = None if self.escalation is None else (self.escalation - self.start).days
        return (user, self.start, self.expiry, self.max_score, self.escalation is not None,
                self.escalation, lead)


def watch_days(alerts: DataFrame, threshold: float = WATCH_THRESHOLD) -> DataFrame:
    """What a day can do to a watch, one row per user-day that can do anything.

    Within a day alerts count in the detectors' order: an escalation resolves a window opened
    the same day only if it comes with or after the forecast that opened it.
    """
    hit = F.coalesce(F.col("forecast_score") >= threshold, F.lit(False))
    rank = F.col("detector_rank")
    return (
        alerts.where(hit | F.col("escalated"))
        .groupBy("user_key", "day")
        .agg(
            F.max(F.when(hit, F.col("forecast_score"))).alias("hit_score"),
            F.bool_or("escalated").alias("escalated"),
            F.coalesce(
                F.max(F.when(F.col("escalated"), rank)) >= F.min(F.when(hit, rank)), F.lit(False)
            ).alias("escalated_after_hit"),
        )
    )


def advance(
    watch: Watch | None,
    day: dt.date,
    hit: float | None,
    escalated: bool,
    escalated_after_hit: bool,
    horizon: int,
    reopen: bool,
) -> tuple[Watch | None, Watch | None]:
    """One day's step: (open window, window closed by this day).

    Without `reopen` a resolved window stays open and goes on absorbing forecasts.
    """
    closed = None
    if watch is not None and day > watch.expiry and (watch.escalation is None or reopen):
        closed, watch = watch, None
    opened = False
    if hit is not None:
        if watch is None:
            watch = Watch(day, day + dt.timedelta(days=horizon), hit)
            opened = True
        else:
            watch.max_score = max(watch.max_score, hit)
    counts = escalated_after_hit if opened else escalated
    if watch is not None and watch.escalation is None and counts and day <= watch.expiry:
        watch.escalation = day
    return watch, closed


def watch_frame(rows: Iterable[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in WATCH_SCHEMA.split(", ")]
    out = pd.DataFrame(list(rows), columns=names)
    out["lead_time_days"] = out["lead_time_days"].astype("Int32")
    return out


def watch_windows(
    alerts: DataFrame,
    threshold: float = WATCH_THRESHOLD,
    horizon: int = WATCH_HORIZON,
    reopen: bool = False,
) -> DataFrame:
    """All watch windows of canonical alerts: a fold over each user's days of interest, in order."""
    day = F.struct("day", "hit_score", "escalated", "escalated_after_hit")
    users = watch_days(alerts, threshold).groupBy("user_key").agg(F.sort_array(F.collect_list(day)).alias("days"))
    window = "struct<start:date,expiry:date,score:double,escalation:date>"
    none = F.lit(None)

    def window_of(start: Column, expiry: Column, score: Column, escalation: Column) -> Column:
        return F.struct(
            start.alias("start"), expiry.alias("expiry"), score.alias("score"), escalation.alias("escalation")
        ).cast(window)

    def step(state: Column, d: Column) -> Column:
        was = state["open"]
        over = was.isNotNull() & (d["day"] > was["expiry"]) & (was["escalation"].isNull() | F.lit(reopen))
        kept = F.when(~F.coalesce(over, F.lit(False)), was)
        hit = d["hit_score"].isNotNull()
        opened = window_of(
            d["day"], F.date_add(d["day"], horizon), d["hit_score"], F.when(d["escalated_after_hit"], d["day"])
        )
        resolves = kept["escalation"].isNull() & d["escalated"] & (d["day"] <= kept["expiry"])
        went_on = window_of(
            kept["start"], kept["expiry"], F.when(hit, F.greatest(kept["score"], d["hit_score"])).otherwise(kept["score"]),
            F.when(resolves, d["day"]).otherwise(kept["escalation"]),
        )
        now = F.when(kept.isNotNull(), went_on).when(hit, opened).otherwise(none.cast(window))
        done = F.when(F.coalesce(over, F.lit(False)), F.array_append(state["done"], was)).otherwise(state["done"])
        return F.struct(now.alias("open"), done.alias("done"))

    begin = F.struct(none.cast(window).alias("open"), F.array().cast(f"array<{window}>").alias("done"))
    closed = F.aggregate(
        "days", begin, step,
        lambda s: F.when(s["open"].isNotNull(), F.array_append(s["done"], s["open"])).otherwise(s["done"]),
    )
    rows = users.select("user_key", F.inline(closed))
    return rows.select(
        "user_key",
        F.col("start").alias("start_day"),
        F.col("expiry").alias("expiry_day"),
        F.col("score").alias("max_score"),
        F.col("escalation").isNotNull().alias("resolved"),
        F.col("escalation").alias("escalation_day"),
        F.date_diff("escalation", "start").alias("lead_time_days"),
    )
