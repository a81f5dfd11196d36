"""Roll-ups of canonical alerts: users, days, detectors, forecasts.

Every report takes `as_of` and then sees no later alert. Groups here are users or days of
alerts, at most four per user-day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import scoring
from vigil.functions.scoring import SPIKE_THRESHOLD, STRONG_SIGNAL, WATCH_THRESHOLD
from vigil.operators.enrich import as_of as visible
from vigil.operators.rolling import recent_days
from vigil.operators.rules import CHAIN, CHAIN_POST, NEAR_MISS


#: The columns that `pulse` and `user_totals` read.
ROLLED_UP = ("user_key", "day", "rule_hits", "ml_score", "anomaly_score", "forecast_score", "ensemble_score", "escalated")
#: Those that `heartbeat_watchlist` reads.
WATCHLISTED = ("user_key", "day", "forecast_score", "escalated")

# --- per user-day -----------------------------------------------------------------------


def user_day_rollup(alerts: DataFrame, as_of=None, term: DataFrame | None = None) -> DataFrame:
    """One row per user-day: union of rule hits, maxima, worst severity, leading alert."""
    seen = visible(alerts, as_of)
    lead = F.struct(F.col("ensemble_score"), (-F.col("detector_rank")).alias("first"), F.col("alert_id"))
    rolled = seen.groupBy("user_key", "day").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_hits")))).alias("rule_hits"),
        F.max("rules_score").alias("rules_score"),
        F.max("ml_score").alias("ml_score"),
        F.max("anomaly_score").alias("anomaly_score"),
        F.max("forecast_score").alias("forecast_score"),
        F.max("ensemble_score").alias("ensemble_score"),
        F.max(scoring.severity_rank(F.col("severity"))).alias("__rank"),
        F.bool_or("escalated").alias("escalated"),
        F.max(lead).alias("__lead"),
    )
    out = rolled.withColumns(
        {"severity": scoring.severity_name(F.col("__rank")), "alert_id": F.col("__lead.alert_id")}
    ).drop("__rank", "__lead")
    if term is None:
        return out.withColumn("after_termination", F.lit(False))
    gone = term.where("is_terminated").select("user_key", F.col("last_seen").alias("__gone"))
    after = F.coalesce(F.col("day") > F.col("__gone"), F.lit(False))
    return out.join(gone, "user_key", "left").withColumn("after_termination", after).drop("__gone")


def same_day_max(alerts: DataFrame) -> DataFrame:
    """Alerts with the day's maxima in place of their own scores; the ensemble is left alone."""
    day = Window.partitionBy("user_key", "day")
    names = ("ml_score", "anomaly_score", "forecast_score")
    return alerts.withColumns({n: F.max(n).over(day) for n in names})


# --- per user ---------------------------------------------------------------------------


def _maxima() -> list[Column]:
    return [
        F.max("ensemble_score").alias("max_ensemble"),
        F.coalesce(F.max("forecast_score"), F.lit(0.0)).alias("__fore"),
    ]


def _severity(ensemble: Column, forecast: Column, capped: bool) -> Column:
    """The graver of ensemble and forecast severity.

    `capped`: with an ensemble below 0.3 a critical forecast only reaches medium.
    """
    own = scoring.bucket(ensemble, scoring.ENSEMBLE_BUCKETS)
    promoted = F.when(forecast > 0, scoring.bucket(forecast, scoring.FORECAST_BUCKETS)).otherwise("low")
    if capped:
        weak = (ensemble < 0.3) & (promoted == "critical")
        lifted = F.when(weak, "medium").otherwise(promoted)
    else:
        lifted = promoted
    graver = scoring.severity_rank(promoted) > scoring.severity_rank(own)
    return F.when(graver, lifted).otherwise(own)


def user_ranking(
    alerts: DataFrame, directory: DataFrame | None = None, as_of=None, tab: str = "all"
) -> DataFrame:
    """Users with counts, maxima, severity and priority; `tab` is all, escalated or watchlist."""
    return ranked_users(user_totals(visible(alerts, as_of)), directory, tab)


def user_totals(alerts: DataFrame) -> DataFrame:
    """Counts and maxima per user, from which `ranked_users` judges; totals of batches can be merged."""
    return alerts.groupBy("user_key").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if("escalated").alias("escalated_alerts"),
        *_maxima(),
    )


def merged_totals(totals: DataFrame) -> DataFrame:
    """One row per user from the totals of several batches."""
    counts = ("total_alerts", "escalated_alerts")
    kept = [c for c in totals.columns if c not in (*counts, "user_key")]
    return totals.groupBy("user_key").agg(*[F.sum(c).alias(c) for c in counts], *[F.max(c).alias(c) for c in kept])


def ranked_users(users: DataFrame, directory: DataFrame | None = None, tab: str = "all") -> DataFrame:
    """Severity and priority from the totals of each user."""
    fore = F.col("__fore")
    users = users.withColumns(
        {
            "severity_bucket": _severity(F.col("max_ensemble"), fore, capped=False),
            "priority_score": F.greatest("max_ensemble", fore),
            "max_forecast": F.when(fore > 0, fore),
        }
    ).drop("__fore")
    if tab == "escalated":
        users = users.where(F.col("escalated_alerts") > 0)
    elif tab == "watchlist":
        users = users.where(F.col("max_forecast") >= WATCH_THRESHOLD)
    return users if directory is None else attach_person(users, directory)


def attach_person(users: DataFrame, people: DataFrame) -> DataFrame:
    """Name, role and employment; `people` has one row per user (`persons`)."""
    joined = users.join(people, "user_key", "left")
    return joined.withColumns(
        {
            "name": F.coalesce("name", "user_key"),
            "user_role": F.coalesce("user_role", F.lit("")),
            "is_terminated": F.coalesce("is_terminated", F.lit(False)),
            "termination_day": F.when(F.col("is_terminated"), F.col("last_seen")),
        }
    ).drop("last_seen")


def persons(directory: DataFrame) -> DataFrame:
    """(user_key, name, user_role, last_seen, is_terminated) from the as-of directory."""
    newest = directory.groupBy("user_key").agg(
        F.max_by(F.struct("employee_name", "role"), "event_month").alias("p"),
        F.max("last_seen").alias("last_seen"),
    )
    end = directory.agg(F.max("last_seen")).scalar()
    return newest.select(
        "user_key",
        F.col("p.employee_name").alias("name"),
        F.col("p.role").alias("user_role"),
        "last_seen",
        (F.col("last_seen") < end).alias("is_terminated"),
    )


def top_risk(users: DataFrame, n: int = 10) -> DataFrame:
    rank = scoring.severity_rank(F.col("severity_bucket"))
    return users.orderBy(rank.desc(), F.col("priority_score").desc(), "user_key").limit(n)


def risk_meta(alerts: DataFrame, people: DataFrame | None = None, as_of=None) -> DataFrame:
    """Severity with the promotion cap, priority, first forecast and first escalation day."""
    seen = visible(alerts, as_of)
    day = F.col("day")
    high = F.col("severity").isin("high", "critical")
    newest = F.struct(day, F.col("detector_rank"))
    users = seen.groupBy("user_key").agg(
        *_maxima(),
        F.min(F.when(F.col("forecast_score") >= SPIKE_THRESHOLD, day)).alias("first_forecast_day"),
        F.min(F.when(F.col("escalated"), day)).alias("first_escalation_day"),
        F.countDistinct(F.when(high, day)).alias("days_high_or_above"),
        F.max_by("severity", newest).alias("last_severity"),
        F.bool_or("escalated").alias("ever_escalated"),
    )
    fore = F.col("__fore")
    users = users.withColumns(
        {
            "severity_bucket": _severity(F.col("max_ensemble"), fore, capped=True),
            "priority_score": F.greatest("max_ensemble", fore),
            "max_forecast": F.when(fore > 0, fore),
        }
    ).drop("__fore")
    if people is None:
        return users.withColumn("termination_day", F.lit(None).cast("date"))
    gone = people.where("is_terminated").select("user_key", F.col("last_seen").alias("termination_day"))
    return users.join(gone, "user_key", "left")


NOTE = "struct<day: date, kind: string, message: string>"


def note_rows(alerts: DataFrame, as_of=None) -> DataFrame:
    """(user_key, day, kind, message): first occurrences, rule events and a summary.

    Rule events of overlapping weeks repeat in the alerts and are made distinct per (user,
    day, kind). The texts are fixed values.
    """
    seen = visible(alerts, as_of)
    day = F.col("day")
    newest = F.struct(day, F.col("detector_rank"))
    spike = F.col("forecast_score") >= SPIKE_THRESHOLD

    def first(flag: Column) -> Column:
        return F.min(F.when(flag, day))

    def hit(name: str) -> Column:
        return F.array_contains("rule_hits", name)

    users = seen.groupBy("user_key").agg(
        F.min(
            F.when(spike, F.struct(day, F.col("detector_rank"), F.col("forecast_score").alias("score")))
        ).alias("spike"),
        first(hit(NEAR_MISS)).alias("near"),
        first(hit(CHAIN)).alias("chain"),
        first(hit(CHAIN_POST)).alias("post"),
        F.max(day).alias("last_day"),
        F.max_by("severity", newest).alias("last_severity"),
        F.countDistinct(F.when(F.col("severity").isin("high", "critical"), day)).alias("high_days"),
        F.bool_or("escalated").alias("escalated"),
        F.max("ensemble_score").alias("ensemble"),
        F.bool_or(F.size("rule_hits") > 0).alias("has_rule"),
        F.coalesce(F.bool_or(F.col("forecast_score") >= WATCH_THRESHOLD), F.lit(False)).alias("has_forecast"),
        F.bool_or(F.col("anomaly_score").isNotNull()).alias("has_anomaly"),
    )

    def note(when: Column, kind: str, message: Column) -> Column:
        made = F.struct(when.alias("day"), F.lit(kind).alias("kind"), message.alias("message"))
        return F.when(when.isNotNull(), made.cast(NOTE))

    prongs = F.array_compact(
        F.array(
            F.when(F.col("has_rule"), "rule chain activity"),
            F.when(F.col("has_forecast"), "elevated forecast scores"),
            F.when(F.col("has_anomaly"), "anomalous behavior"),
        )
    )
    summary = F.concat_ws(
        " ",
        F.format_string("Last Rule-based alert on %s (%s).", F.col("last_day").cast("string"), F.col("last_severity")),
        F.when(
            F.col("high_days") > 0,
            F.format_string(
                "%d day(s) with high/critical alerts; max ensemble %.2f.", F.col("high_days"), F.col("ensemble")
            ),
        ).otherwise(F.format_string("Max ensemble %.2f so far.", F.col("ensemble"))),
        F.when(F.col("escalated"), "Has at least one escalated alert."),
        F.when(F.size(prongs) > 0, F.concat(F.lit("Signals: "), F.concat_ws(", ", prongs), F.lit("."))),
    )
    own = F.array(
        note(
            F.col("spike.day"),
            "forecast_spike",
            F.format_string(
                "Forecast model first predicted elevated exfil risk (%.2f%% likelihood).",
                F.col("spike.score") * 100,
            ),
        ),
        note(
            F.col("near"),
            "near_miss",
            F.lit(
                "Possible preparation for data theft after-hours activity and USB use increased "
                "but no data-leak site access yet."
            ),
        ),
        note(F.col("chain"), "full_chain", F.lit("Pre-departure data theft detected.")),
        note(F.col("post"), "post_departure_chain", F.lit("Post-departure data theft detected.")),
        note(F.col("last_day"), "summary", summary),
    )
    events = (
        seen.select("user_key", F.inline("rule_timeline"))
        .groupBy("user_key", "day", "kind")
        .agg(F.min("message").alias("message"))
        .withColumn("kind", F.concat(F.lit("rule_"), F.col("kind")))
    )
    return users.select("user_key", F.inline(F.array_compact(own))).unionByName(events)


def analyst_notes(alerts: DataFrame, as_of=None) -> DataFrame:
    """(user_key, notes): the note rows of each user as one array in day order, for callers that want it."""
    note = F.struct("day", "kind", "message").cast(NOTE)
    return note_rows(alerts, as_of).groupBy("user_key").agg(F.array_sort(F.collect_list(note)).alias("notes"))


# --- per day ----------------------------------------------------------------------------


def _strong(name: str) -> Column:
    return F.coalesce(F.col(name) > STRONG_SIGNAL, F.lit(False))


def pulse() -> list[Column]:
    """Counts of a day's alerts; each is a sum over rows, so batches can be added."""
    return [
        F.count(F.lit(1)).alias("count"),
        F.count_if("escalated").alias("escalated_count"),
        F.count_if(F.size("rule_hits") > 0).alias("rule_count"),
        F.count_if(_strong("ml_score")).alias("ml_count"),
        F.count_if(_strong("anomaly_score")).alias("anomaly_count"),
    ]


def _on_recent_days(alerts: DataFrame, seen: DataFrame, aggs: list[Column], days: int) -> DataFrame:
    """Aggregates of `alerts` for the last `days` days on which `seen` has any alert."""
    window = recent_days(seen, days)  # `days` rows
    counted = alerts.groupBy("day").agg(*aggs)
    return window.join(counted, "day", "left")


def heartbeat(alerts: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    seen = visible(alerts, as_of)
    return _on_recent_days(seen, seen, pulse(), days)


def heartbeat_user(alerts: DataFrame, user: str, as_of=None, days: int = 7) -> DataFrame:
    """One user's counts on the days that are recent for all; days without any are zero."""
    seen = visible(alerts, as_of)
    mine = seen.where(F.col("user_key") == user.lower())
    top = F.coalesce(F.max("forecast_score"), F.lit(0.0)).alias("forecast_max")
    out = _on_recent_days(mine, seen, [*pulse(), top], days)
    return out.fillna(0).fillna(0.0)


def heartbeat_watchlist(
    alerts: DataFrame, as_of=None, days: int = 7, threshold: float = WATCH_THRESHOLD
) -> DataFrame:
    """Counts of the users whose strongest forecast reaches the threshold."""
    seen = visible(alerts, as_of)
    hit = F.coalesce(F.col("forecast_score") >= threshold, F.lit(False))
    cohort = seen.where(hit).select("user_key").distinct()
    theirs = seen.join(cohort, "user_key", "left_semi")
    aggs = [
        F.count(F.lit(1)).alias("count"),
        F.count_if("escalated").alias("escalated_count"),
        F.countDistinct(F.when(hit, F.col("user_key"))).alias("forecast_hit_count"),
    ]
    return _on_recent_days(theirs, seen, aggs, days).fillna(0)


def detector_day_counts(raw_alerts: DataFrame, n: int = 60) -> DataFrame:
    """Raw alerts per day and detector on the last `n` days with any."""
    kinds = ["rules", "anomaly", "ml"]
    known = raw_alerts.where(F.col("detector").isin(kinds))
    days = recent_days(known, n)
    counts = known.groupBy("day").pivot("detector", kinds).count()
    return days.join(counts, "day").fillna(0, kinds)


def recent_alerts(raw_alerts: DataFrame, n: int = 200) -> DataFrame:
    from vigil.operators.alerts import detector_rank

    known = raw_alerts.where(F.col("detector").isin("rules", "anomaly", "ml"))
    order = [F.col("day").desc(), F.col("user_key").desc(), detector_rank(F.col("detector")).desc()]
    return known.orderBy(*order).limit(n)


# --- forecasts --------------------------------------------------------------------------


def forecast_summary(
    watches: DataFrame, alerts: DataFrame, as_of=None, threshold: float = WATCH_THRESHOLD
) -> DataFrame:
    """How many users were forecast, how many rightly, and how early; one row.

    Two views: within the watch horizon, and from the first strong forecast to the first
    escalation whatever lies between.
    """
    from vigil.operators.ordering import exact_quantiles

    starts = visible(watches, as_of, "start_day")
    right = F.col("resolved") & (F.col("lead_time_days") >= 0)
    if as_of is not None:
        right = right & (F.col("escalation_day") <= F.lit(as_of).cast("date"))
    users = starts.groupBy("user_key").agg(
        F.max(
            F.when(
                right,
                F.struct(
                    F.col("lead_time_days").cast("bigint").alias("lead"),
                    (-F.unix_date("start_day")).alias("early"),
                    F.col("start_day"),
                    F.col("escalation_day"),
                ),
            )
        ).alias("best")
    )
    seen = visible(alerts, as_of)
    first_esc = seen.groupBy("user_key").agg(
        F.min(F.when(F.col("escalated"), F.col("day"))).alias("escalation"),
        F.min(F.when(F.col("forecast_score") >= threshold, F.col("day"))).alias("forecast"),
    )
    early = first_esc.where(F.col("forecast") <= F.col("escalation")).withColumn(
        "lead", F.date_diff("escalation", "forecast").cast("bigint")
    )
    leads = users.where(F.col("best").isNotNull()).select("user_key", "best.*")

    def longest(df: DataFrame, *fields: str) -> Column:
        """The row with the longest lead, as one struct value."""
        first = df.orderBy(F.col("lead").desc(), "user_key").limit(1)
        return first.select(F.struct("lead", "user_key", *fields)).scalar()

    median = exact_quantiles(leads, "lead", [0.5], ["m"]).scalar()
    median_early = exact_quantiles(early, "lead", [0.5], ["m"]).scalar()
    zero = F.lit(0).cast("bigint")
    out = users.agg(
        F.count(F.lit(1)).alias("total_forecasted_users"),
        F.count("best").alias("correct_forecasts"),
    )
    packed = out.withColumns(
        {
            "b": longest(leads, "start_day", "escalation_day"),
            "e": longest(early, "forecast", "escalation"),
            "median_lead_time_days": F.coalesce(median, F.lit(0.0)),
            "median_early_warning_lead_days": F.coalesce(median_early, F.lit(0.0)),
        }
    )
    return packed.withColumns(
        {
            "best_lead_time_days": F.coalesce("b.lead", zero),
            "best_lead_time_user": F.col("b.user_key"),
            "best_lead_time_first_forecast": F.col("b.start_day"),
            "best_lead_time_escalation": F.col("b.escalation_day"),
            "best_early_warning_lead_days": F.coalesce("e.lead", zero),
            "best_early_warning_user": F.col("e.user_key"),
            "best_early_warning_first_forecast": F.col("e.forecast"),
            "best_early_warning_escalation": F.col("e.escalation"),
        }
    ).drop("b", "e")
