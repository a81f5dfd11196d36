"""The rule detector: after-hours work, USB use and a leak site within a week."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.rolling import last_days, last_rows
from vigil.schemas import (
    COUNT_COLUMNS,
    DOMAINS,
    LEAK,
    POST_DEPARTURE_COLUMNS,
    RATE_COLUMNS,
    ROLLING_COLUMNS,
    USB,
)

# Everything the rules read of a user-day.
INPUTS = (
    "user_key", "day", *COUNT_COLUMNS.values(), *RATE_COLUMNS.values(), "email_n_after_hours",
    USB, LEAK, *POST_DEPARTURE_COLUMNS.values(), *ROLLING_COLUMNS,
)

CHAIN_POST = "s1_chain_post_departure"
CHAIN = "s1_chain"
NEAR_MISS = "s1_near_miss"


@dataclass(frozen=True)
class RuleParams:
    """Thresholds of the rules."""

    min_rate: float = 0.5
    min_events_per_domain: int = 3
    min_combined_events: int = 3
    days: int = 7
    min_days: int = 3
    near_miss_usb: int = 4
    window_rows: int = 14
    leak_days: int = 1


# Score of each case, the gravest first.
CASE_SCORES = ((CHAIN_POST, 0.95), (CHAIN, 0.8), (NEAR_MISS, 0.3))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def ah_signal(daily: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """`ah_sig`: enough after-hours events over the domains where they prevail."""
    total = F.lit(0.0)
    for domain in DOMAINS:
        n, rate = _zero(COUNT_COLUMNS[domain]), _zero(RATE_COLUMNS[domain])
        estimate = n * rate
        if domain == "email":
            counted = _zero("email_n_after_hours")
            estimate = F.when(counted > 0, counted).otherwise(estimate)
        prevails = (n >= params.min_events_per_domain) & (rate >= params.min_rate)
        total = total + F.when(prevails, estimate).otherwise(0.0)
    return daily.withColumn("ah_sig", total >= params.min_combined_events)


def rule_measures(daily: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """The week's counts behind the rules, for every user-day.

    The frame is the last `days` calendar days; the window a detector sees is capped at 14
    rows, which a week of daily rows never reaches.
    """
    df = ah_signal(daily, params)
    week, today = last_days(params.days), last_days(params.leak_days)
    usb, leak = _zero(USB), _zero(LEAK)
    post = F.lit(0.0)
    for column in POST_DEPARTURE_COLUMNS.values():
        post = post + _zero(column)

    def days(flag: Column, frame=week) -> Column:
        return F.sum(flag.cast("bigint")).over(frame)

    measures = {
        "window_start": F.min("day").over(last_rows(params.window_rows)),
        "active_days": F.count(F.lit(1)).over(week),
        "ah_sig_days_7d": days(F.col("ah_sig")),
        "usb_days_7d": days(usb > 0),
        "usb_total_7d": F.sum(usb).over(week).cast("bigint"),
        "same_day_ah_usb_7d": days(F.col("ah_sig") & (usb > 0)),
        "wikileaks_days_N": days(leak > 0, today),
        "ah_novel_7d": F.sum(_zero("ah_novel")).over(week).cast("bigint"),
        "usb_novel_7d": F.sum(_zero("usb_novel")).over(week).cast("bigint"),
        "latest_usb": usb.cast("bigint"),
        "post_departure_events_today": post,
        "post_departure_today": post > 0,
        "leak_today": leak > 0,
    }
    return df.withColumns(measures)


def chain_rule(measures: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """`has_chain`, `near_miss` and `has_chain_post`."""
    enough = F.col("active_days") >= params.min_days
    strong = (F.col("same_day_ah_usb_7d") > 0) | (
        (F.col("ah_sig_days_7d") >= 2) & (F.col("usb_days_7d") >= 2)
    )
    novel = (F.col("ah_novel_7d") > 0) & (F.col("usb_novel_7d") > 0)
    leak = F.col("wikileaks_days_N") > 0
    base = enough & strong & novel
    near = (
        base
        & (F.col("usb_total_7d") >= params.near_miss_usb)
        & (F.col("latest_usb") > 0)
        & ~leak
    )
    return measures.withColumns(
        {
            "has_chain": base & leak,
            "near_miss": near,
            "has_chain_post": base & leak & F.col("post_departure_today"),
        }
    )


def rule_case() -> Column:
    return (
        F.when(F.col("has_chain_post"), CHAIN_POST)
        .when(F.col("has_chain"), CHAIN)
        .when(F.col("near_miss"), NEAR_MISS)
    )


def rule_score(case: Column) -> Column:
    expr = None
    for name, score in CASE_SCORES:
        expr = F.when(case == name, score) if expr is None else expr.when(case == name, score)
    return expr


def rule_evidence(params: RuleParams = RuleParams()) -> Column:
    """What a rule alert rests on; the name of the method is a fixed value."""
    return F.struct(
        "ah_sig_days_7d",
        "usb_days_7d",
        "usb_total_7d",
        "same_day_ah_usb_7d",
        "wikileaks_days_N",
        F.lit(params.leak_days).alias("wl_lookback_days"),
        "window_start",
        F.col("day").alias("window_end"),
        F.lit(params.min_days).alias("min_window_days"),
        F.lit("combined(rate*count, domain mins)").alias("ah_method"),
        "ah_novel_7d",
        "usb_novel_7d",
        "post_departure_today",
        "post_departure_events_today",
    )


def rule_summary(case: Column, e: Column) -> Column:
    """Plain-language summary; the texts are fixed values."""
    post = F.lit(
        "Post-departure data theft pattern over the last 7 days. "
        "After-hours logins, USB activity, and traffic to a known data-leak site "
        "continue after the user left the organization."
    )
    chain = F.format_string(
        "Likely data theft over the last 7 days. "
        "Heavy after-hours activity on %d day(s). "
        "USB device use on %d day(s), %d total connections. "
        "Same-day after-hours + USB on %d day(s). "
        "Traffic to a known data-leak site on %d day(s).",
        e["ah_sig_days_7d"], e["usb_days_7d"], e["usb_total_7d"],
        e["same_day_ah_usb_7d"], e["wikileaks_days_N"],
    )
    near = F.format_string(
        "Possible preparation for data theft. "
        "After-hours activity and USB use have increased in the last 7 days. "
        "USB used %d times across %d day(s). "
        "No traffic to known data-leak sites has been observed yet.",
        e["usb_total_7d"], e["usb_days_7d"],
    )
    other = F.lit(
        "Unusual pattern of after-hours access and USB use that may relate to data theft."
    )
    return F.when(case == CHAIN_POST, post).when(case == CHAIN, chain).when(case == NEAR_MISS, near).otherwise(other)


def _mark(flag: Column, kind: str, message: Column) -> Column:
    return F.when(
        flag, F.struct(F.col("day"), F.lit(kind).alias("kind"), message.alias("message"))
    )


def day_marks() -> Column:
    """Timeline entries of one user-day; kinds and texts are fixed values."""
    usb = _zero(USB)
    marks = F.array(
        _mark(F.col("ah_sig"), "after_hours", F.lit("After-hours activity above normal levels.")),
        _mark(
            usb > 0,
            "usb",
            F.format_string("USB device connected (%d events) during this day.", usb.cast("bigint")),
        ),
        _mark(
            _zero(LEAK) > 0,
            "leak_site",
            F.lit("Traffic to a known data-leak site (wikileaks.org)."),
        ),
    )
    return F.filter(marks, lambda m: m.isNotNull())


def with_timeline(measures: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """`rule_timeline`: the week's entries in order; a post-departure case ends with its own."""
    marked = measures.withColumn("__marks", day_marks())
    week = F.flatten(F.collect_list("__marks").over(last_days(params.days)))
    closing = F.array(
        F.struct(
            F.col("day"),
            F.lit("post_departure_chain").alias("kind"),
            F.lit("Data-theft pattern continues after the user left the organization.").alias("message"),
        )
    )
    full = F.when(F.col("has_chain_post"), F.concat(week, closing)).otherwise(week)
    return marked.withColumn("rule_timeline", full).drop("__marks")


def rule_alerts(daily: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """At most one alert per user-day, the gravest case that holds."""
    judged = chain_rule(rule_measures(daily, params), params).withColumn("__case", rule_case())
    # Messages are made only for weeks that end in a fired day.
    ahead = Window.partitionBy("user_key").orderBy(F.unix_date("day")).rangeBetween(0, params.days - 1)
    judged = judged.withColumn("__near", F.max("__case").over(ahead)).where(F.col("__near").isNotNull())
    fired = with_timeline(judged.drop("__near"), params).where(F.col("__case").isNotNull())
    case = F.col("__case")
    built = fired.withColumn("evidence", rule_evidence(params))
    return built.select(
        "day",
        "user_key",
        F.lit("rules").alias("detector"),
        F.concat(F.lit("rules:"), case).alias("reason"),
        rule_score(case).alias("score"),
        "evidence",
        rule_summary(case, F.col("evidence")).alias("human_summary"),
        "rule_timeline",
    )


def last_n_days(windows: DataFrame, n: int) -> DataFrame:
    """Windows cut to the `n` calendar days before their end."""
    first = F.date_sub(F.col("end_day"), n - 1)
    return windows.withColumn(
        "window", F.filter("window", lambda row: row["day"] >= first)
    )


def timeline_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "user_key", F.col("day").alias("alert_day"), F.inline("rule_timeline")
    )


