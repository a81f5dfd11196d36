"""Tables the queries share, from the driver's files up to canonical alerts.

The fixture is short and thin, so thresholds that need long or dense histories are lowered
here (FIXTURES.md); the operators' own defaults stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import times
from vigil.operators import alerts as alert_ops
from vigil.operators import anomaly, baselines, daily, enrich, labels, machines, rolling, rules, supervised
from vigil.session import staged
from vigil.sources import driver_tables as tables

RULES = rules.RuleParams(min_events_per_domain=1, min_combined_events=1)
BASELINE_DAYS = 14
MIN_PRIOR = 5
GROUP_MINIMUM = {g: 20 for g in baselines.GROUP_MINIMUM}
SHARED = {"lo": 3, "hi": 5, "top": 3}
AS_OF = "2024-01-28"
#: What the alerts of scored windows read.
ALERTED = ("user_key", "end_day", "base_score", "forecast", "z_personal", "z_role", "z_max")


def non_admin_logons(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.exclude_admins(tables.logons(spark, sf), tables.event_users(spark, sf))


def shared_list(spark: SparkSession, sf: str) -> DataFrame:
    return machines.choose_shared(machines.pc_sharedness(non_admin_logons(spark, sf)), **SHARED)


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return machines.assigned_pc(tables.logons(spark, sf), shared_list(spark, sf))


def counts(spark: SparkSession, sf: str, domain: str | None = None) -> DataFrame:
    """Additive measures per (user, day, domain, machine) with the context flags.

    Context is joined after this first aggregation, so the raw events are read and shuffled
    once, and only as partial sums: which machines are shared and whose they are is told from
    the same sums.
    """
    wanted = None if domain is None else sorted({domain, "logon"})
    base = daily.pc_day_counts(tables.activity(spark, sf, wanted))
    base = staged(base.withColumn("event_month", times.month_start(F.col("day"))), "pc-days")
    logon = base.where(F.col("domain") == "logon")
    people = tables.event_users(spark, sf)
    shared = machines.choose_shared(machines.pc_sharedness(enrich.exclude_admins(logon, people)), **SHARED)
    shared = staged(shared, "shared-pcs")
    df = base if domain is None else base.where(F.col("domain") == domain)
    df = enrich.flag_shared_pc(df, shared)
    df = enrich.flag_unassigned_pc(df, machines.assigned_pc(logon, shared))
    return enrich.flag_active(enrich.join_bounds(df, people))


def lean_counts(spark: SparkSession, sf: str) -> DataFrame:
    """`counts` for those who ask nothing about machines: their flags are NULL, and nothing is staged,
    so measures that are not asked for are pruned down to the events."""
    base = daily.pc_day_counts(tables.activity(spark, sf))
    unknown = F.lit(None).cast("boolean")
    base = base.withColumns({
        "event_month": times.month_start(F.col("day")), "on_shared_pc": unknown, "on_unassigned_pc": unknown,
    })
    return enrich.flag_active(enrich.join_bounds(base, tables.event_users(spark, sf)))


def daily_user(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_user_tall(counts(spark, sf))


def _with_rolling(days: DataFrame) -> DataFrame:
    return rolling.add_rolling(daily.ah_rate_1d(days), baseline_days=BASELINE_DAYS)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The wide user-day table with rolling columns."""
    return _with_rolling(daily_user(spark, sf))


def detector_features(spark: SparkSession, sf: str) -> DataFrame:
    """The columns rules and stand-in scores read, staged; what else the wide table has is
    pruned from the whole plan down to the events. None of them tells anything about machines."""
    days = _with_rolling(daily.daily_user_tall(lean_counts(spark, sf)))
    return staged(days.select(*rules.INPUTS), "features")


def keys(spark: SparkSession, sf: str) -> DataFrame:
    """Just the active user-days."""
    events = tables.table(spark, sf, "events")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("user_key"), F.col("ts").cast("date").alias("day")
    ).distinct()


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    return tables.ranges(keys(spark, sf))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Malicious user-days."""
    labelled = labels.label_days(keys(spark, sf), ranges(spark, sf))
    return labelled.where(F.col("label") == 1).select("user_key", "day")


def insiders(spark: SparkSession, sf: str) -> DataFrame:
    return ranges(spark, sf).select(
        "user_key", F.lit("1").alias("scenario"),
        F.col("exfil_start").alias("start"), F.col("exfil_end").alias("end"),
    )


def scored_days(feats: DataFrame) -> DataFrame:
    """Stand-ins for the model scores, computable in SQL: one row per full 14-row window.

    `base_score` is scaled by the range of all windows, as the forest's score is.
    """
    frame = rolling.last_rows(14)
    rows = F.count(F.lit(1)).over(frame)
    zero = F.lit(0.0)
    web = F.avg(F.coalesce(F.col("http_n_http").cast("double"), zero)).over(frame)
    usb = F.sum("usb_count_1d").over(frame)
    ah = F.avg("ah_rate_1d").over(frame)
    raw = 0.45 * ah + 0.35 * F.least(F.lit(1.0), usb / 14.0) + 0.2 * F.least(F.lit(1.0), web / 3.0)
    trend = F.col("usb_count_trend")
    forecast = F.least(F.lit(1.0), 0.712347 * F.col("ah_rate_trend") + 0.733391 * trend / (trend + 3.0))
    return feats.select(
        "user_key",
        F.col("day").alias("end_day"),
        rows.alias("__rows"),
        F.round(raw, 6).alias("raw"),
        F.round(forecast, 9).alias("forecast"),
    ).where(F.col("__rows") == 14).drop("__rows")


def window_scores(spark: SparkSession, sf: str, feats: DataFrame | None = None) -> DataFrame:
    """(user_key, end_day, base_score, forecast, organisation)."""
    days = staged(scored_days(features(spark, sf) if feats is None else feats), "scores")
    span = days.agg(F.struct(F.min("raw").alias("lo"), F.max("raw").alias("hi"))).scalar()
    base = F.round((F.col("raw") - span["lo"]) / (span["hi"] - span["lo"]), 9)
    return baselines.attach_org(days.withColumn("base_score", base), tables.event_org(spark, sf))


def zscores(spark: SparkSession, sf: str, feats: DataFrame | None = None) -> DataFrame:
    return baselines.all_baselines(window_scores(spark, sf, feats), MIN_PRIOR, GROUP_MINIMUM)


def score_alerts(z: DataFrame) -> DataFrame:
    """Forecast and supervised alerts of scored windows."""
    ml = F.round(1.0 / (1.0 + F.exp(-(8.0 * F.col("base_score") - 4.4))), 9)
    forecast = supervised.forecast_alerts(z.select("user_key", "end_day", F.col("forecast").alias("score")))
    return forecast.unionByName(supervised.supervised_alerts(z.select("user_key", "end_day", ml.alias("score"))))


def raw_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of all four detectors: rules on the features, the others on the stand-in scores."""
    feats = detector_features(spark, sf)
    z = staged(zscores(spark, sf, feats).select(*ALERTED), "zscores")
    fired = rules.rule_alerts(feats, RULES)
    return alert_ops.all_alerts(fired, anomaly.anomaly_alerts(z), score_alerts(z))


def canonical(spark: SparkSession, sf: str, columns: Sequence[str] = ()) -> DataFrame:
    """Canonical alerts, staged: reports read them more than once.

    A report that names its `columns` is spared the others, above all the texts.
    """
    alerts = alert_ops.normalize_alerts(raw_alerts(spark, sf))
    return staged(alerts.select(*columns) if columns else alerts, "alerts")
