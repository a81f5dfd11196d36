"""From detector alerts to the canonical alert with ensemble score and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import scoring
from vigil.operators.rules import CHAIN, CHAIN_POST, NEAR_MISS
from vigil.schemas import ALERT, EVIDENCE, POST_DEPARTURE_COLUMNS

# Canonical order of the detectors within a user-day.
DETECTORS = ("rules", "anomaly", "forecast", "ml")


def detector_rank(detector: Column) -> Column:
    return F.coalesce(
        F.array_position(F.array(*[F.lit(d) for d in DETECTORS]), detector), F.lit(0)
    ).cast("int")


def _as_alert(df: DataFrame) -> DataFrame:
    """Bring a detector's output to the alert type, absent fields as NULL."""
    out = []
    for field in ALERT.fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name == "evidence":
            have = df.schema["evidence"].dataType.fieldNames()
            parts = [
                (F.col(f"evidence.{e.name}") if e.name in have else F.lit(None)).cast(e.dataType).alias(e.name)
                for e in EVIDENCE.fields
            ]
            out.append(F.struct(*parts).alias("evidence"))
        else:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*out)


def union_alerts(*detectors: DataFrame) -> DataFrame:
    """The detectors' alerts as one table."""
    tables = [_as_alert(d) for d in detectors]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def all_alerts(*detectors: DataFrame) -> DataFrame:
    """All detectors' alerts, the supervised ones with the day's maxima."""
    return prong_maxima(union_alerts(*detectors))


def prong_maxima(alerts: DataFrame) -> DataFrame:
    """Carry the day's maximum of every detector on the supervised alert.

    A user-day has a handful of alerts, so the window replaces a join with an aggregate.
    """
    day = Window.partitionBy("user_key", "day")
    mine = F.col("detector") == "ml"

    def best(detector: str) -> Column:
        score = F.when(F.col("detector") == detector, F.col("score"))
        return F.coalesce(F.max(score).over(day), F.lit(0.0))

    names = {"rules": "rules_score", "anomaly": "anomaly_score", "forecast": "forecast_score", "ml": "ml_score"}
    return alerts.withColumns({n: F.when(mine, best(d)) for d, n in names.items()})


def post_departure_flag(daily: DataFrame) -> DataFrame:
    """`is_post_departure_window`: past the last month seen, or post-departure events today.

    Needs `is_post_departure` from the termination join.
    """
    events = F.lit(0)
    for column in POST_DEPARTURE_COLUMNS.values():
        events = events + F.coalesce(F.col(column), F.lit(0))
    return daily.withColumn("is_post_departure_window", F.col("is_post_departure") | (events > 0))


def normalize_alerts(alerts: DataFrame) -> DataFrame:
    """Canonical alerts: rule hits, one score per detector, ensemble, severity, explanation."""
    detector, score = F.col("detector"), F.coalesce("score", F.lit(0.0))
    by_rules = detector == "rules"
    suffix = F.when(
        F.contains("reason", F.lit(":")), F.regexp_extract("reason", r"^[^:]*:(.*)$", 1)
    ).otherwise(F.col("reason"))
    no_hits = F.array().cast("array<string>")
    hits = F.when(by_rules & (F.length(suffix) > 0), F.array(suffix)).otherwise(no_hits)
    df = alerts.select(
        F.sha2(F.concat_ws("|", F.col("day").cast("string"), "user_key", "detector", "reason"), 256).alias("alert_id"),
        "day",
        F.lower("user_key").alias("user_key"),
        F.lit("SCENARIO_1").alias("scenario_id"),
        detector_rank(detector).alias("detector_rank"),
        hits.alias("rule_hits"),
        F.when(by_rules, score).otherwise(F.coalesce("rules_score", F.lit(0.0))).alias("rules_score"),
        F.when(detector == "ml", F.coalesce("score", "rules_score", F.lit(0.0)))
        .otherwise(F.coalesce("ml_score", F.lit(0.0))).alias("ml_score"),
        F.when(detector == "anomaly", score).otherwise(F.col("anomaly_score")).alias("anomaly_score"),
        F.when(detector == "anomaly", F.col("evidence.severity")).alias("anomaly_severity"),
        F.when(detector == "forecast", score).otherwise(F.col("forecast_score")).alias("forecast_score"),
        F.col("human_summary").alias("rule_human_summary"),
        F.coalesce("rule_timeline", F.array().cast(ALERT["rule_timeline"].dataType)).alias("rule_timeline"),
    )
    return ensemble(df)


def _hit(name: str) -> Column:
    return F.array_contains("rule_hits", name)


def ensemble(alerts: DataFrame) -> DataFrame:
    """`ensemble_score`, `severity`, `escalated` and `explanation` of canonical alerts.

    A completed chain overrides the logistic score; severity alone decides on escalation.
    """
    post, chain, near = _hit(CHAIN_POST), _hit(CHAIN), _hit(NEAR_MISS)
    ml = F.col("ml_score")
    anomaly = F.coalesce("anomaly_score", F.lit(0.0))
    forecast = F.coalesce("forecast_score", F.lit(0.0))
    p = scoring.logistic(
        (post | chain).cast("double"), near.cast("double"), ml, anomaly, forecast
    )
    df = alerts.withColumn(
        "ensemble_score",
        F.when(post, 1.0).when(chain, F.greatest(p, F.lit(0.95))).otherwise(p),
    )
    severity = F.when(post | chain, "critical").otherwise(
        scoring.bucket(F.col("ensemble_score"), scoring.ALERT_BUCKETS)
    )
    case = F.when(post, CHAIN_POST).when(chain, CHAIN).when(near, NEAR_MISS).otherwise("none")
    df = df.withColumns({"severity": severity, "rule_case": case})
    df = df.withColumn("escalated", F.col("severity").isin("high", "critical"))
    return df.withColumn("explanation", explanation()).drop("rule_case")


def driver() -> Column:
    """The rule case, else the detector with the highest score."""
    ml = F.col("ml_score")
    anomaly = F.coalesce("anomaly_score", F.lit(0.0))
    forecast = F.coalesce("forecast_score", F.lit(0.0))
    dominant = (
        F.when(forecast >= F.greatest(ml, anomaly), "forecast")
        .when(anomaly >= F.greatest(ml, forecast), "anomaly")
        .otherwise("ML")
    )
    return F.when(F.col("rule_case") != "none", F.col("rule_case")).otherwise(dominant)


def explanation() -> Column:
    """Driver, weights and texts of the components, and a one-line summary; the texts are fixed values."""
    case = F.col("rule_case")
    rule_weight = F.when(case.isin(CHAIN_POST, CHAIN), 1.0).when(case == NEAR_MISS, 0.5).otherwise(0.0)

    def described(score: Column, none: str, text: str) -> Column:
        return F.when(score.isNull(), none).otherwise(F.format_string(text, score))

    anomaly, forecast = F.col("anomaly_score"), F.col("forecast_score")
    anomaly_text = F.when(
        anomaly.isNotNull() & F.col("anomaly_severity").isNotNull(),
        F.format_string("Anomaly %s: %.4f", F.col("anomaly_severity"), anomaly),
    ).otherwise(described(anomaly, "No anomaly score", "Anomaly score: %.4f"))
    state = F.when(F.col("escalated"), "Escalated").otherwise("Non-escalated")
    return F.struct(
        F.col("ensemble_score"),
        F.col("escalated"),
        F.col("severity"),
        F.col("rule_hits"),
        case.alias("rule_case"),
        driver().alias("driver"),
        F.struct(
            F.struct(
                (F.size("rule_hits") > 0).alias("fired"),
                F.col("rule_hits").alias("hits"),
                rule_weight.alias("weight"),
                F.concat(F.lit("Rule case: "), case).alias("contribution_description"),
            ).alias("rule"),
            F.struct(
                F.col("ml_score").alias("score"),
                F.lit(1.0).alias("weight"),
                F.format_string("Raw ML score: %.4f", F.col("ml_score")).alias("contribution_description"),
            ).alias("ml"),
            F.struct(
                anomaly.alias("score"),
                F.col("anomaly_severity").alias("severity"),
                anomaly.isNotNull().cast("double").alias("weight"),
                anomaly_text.alias("contribution_description"),
            ).alias("anomaly"),
            F.struct(
                forecast.alias("score"),
                forecast.isNotNull().cast("double").alias("weight"),
                described(forecast, "No forecast score", "Forecast score: %.4f").alias("contribution_description"),
            ).alias("forecast"),
        ).alias("components"),
        F.format_string(
            "Ensemble %.2f (%s). Driven by %s.", F.col("ensemble_score"), state, driver()
        ).alias("human_readable_summary"),
    )
