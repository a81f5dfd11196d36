"""Anomaly alerts: a window score, raised or damped by its deviation from baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scoring import clip

# Boost by z_max, the highest bound first; below the last one the score is damped.
BOOSTS = ((3.5, 0.3), (3.0, 0.2), (2.5, 0.1))
DAMP_BELOW, DAMP = 1.0, -0.5
GATE_SCORE, GATE_Z = 0.5, 2.0
CAP, FLOOR = 0.9, 0.4


def boost(z: Column) -> Column:
    expr = None
    for bound, value in BOOSTS:
        expr = F.when(z >= bound, value) if expr is None else expr.when(z >= bound, value)
    return expr.when(z < DAMP_BELOW, DAMP).otherwise(0.0)


def z_boost(scores: DataFrame) -> DataFrame:
    """Scores worth an alert, with `boost_pct` (a fraction) and the final `score`."""
    base, z = F.col("base_score"), F.col("z_max")
    quiet = (base < GATE_SCORE) & (z.isNull() | (z < GATE_Z))
    kept = scores.where(~quiet).withColumn("boost_pct", boost(z))
    final = clip(base * (1.0 + F.col("boost_pct")), 0.0, CAP)
    return kept.withColumn("score", final).where(F.col("score") >= FLOOR)


def anomaly_evidence(scores: DataFrame, window_days: int = 14) -> Column:
    raw = F.col("base_score_raw") if "base_score_raw" in scores.columns else F.lit(None).cast("double")

    def opt(name: str) -> Column:
        return F.col(name) if name in scores.columns else F.lit(None).cast("double")

    return F.struct(
        F.round("base_score", 4).alias("anomaly_score_raw"),
        F.round("score", 4).alias("anomaly_score_boosted"),
        F.round(F.col("boost_pct") * 100, 1).alias("boost_pct"),
        F.round(raw, 4).alias("base_score_raw_if"),
        F.round(opt("z_personal"), 2).alias("z_personal"),
        F.round(opt("z_role"), 2).alias("z_role"),
        F.round("z_max", 2).alias("z_max"),
        F.lit(window_days).alias("window_days"),
        F.col("end_day").alias("window_end"),
    )


def anomaly_alerts(scores: DataFrame) -> DataFrame:
    """Alerts from scores that carry `base_score` and `z_max`."""
    hot = z_boost(scores)
    return hot.select(
        F.col("end_day").alias("day"),
        "user_key",
        F.lit("anomaly").alias("detector"),
        F.lit("anomaly:isolation_forest").alias("reason"),
        "score",
        anomaly_evidence(hot).alias("evidence"),
    )


def z_coverage(alerts: DataFrame) -> DataFrame:
    """How many anomaly alerts carry z-scores and how many were boosted or damped."""
    e = F.col("evidence")
    has_z = e["z_personal"].isNotNull() | e["z_role"].isNotNull() | e["z_max"].isNotNull()
    mine = alerts.where(F.col("detector") == "anomaly")
    return mine.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_z).alias("n_with_z"),
        F.count_if(F.coalesce(e["boost_pct"], F.lit(0.0)) != 0).alias("n_boosted"),
    )
