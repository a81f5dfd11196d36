"""Alerts and scores against ground truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ordering import exact_quantiles, running_totals

# The severity sets that are compared.
SEVERITY_SETS = {
    "ALL": ("critical", "high", "medium", "low"),
    "critical": ("critical",),
    "critical+high": ("critical", "high"),
    "critical+high+medium": ("critical", "high", "medium"),
}
RECALL_TARGETS = (0.10, 0.20, 0.50, 0.80, 0.90)
VOLUME_PERCENTILES = (90.0, 95.0, 99.0, 99.5)
PATTERNS = ("wikileaks_days_N", "usb_novel_7d", "usb_total_7d")


def severity_breakdown(alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    total = alerts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.col("n") / total * 100)


def match_truth(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """User-days alerted, malicious or both."""
    predicted = alerts.select("user_key", "day").distinct().withColumn("predicted", F.lit(True))
    actual = truth.select("user_key", "day").distinct().withColumn("actual", F.lit(True))
    joined = predicted.join(actual, ["user_key", "day"], "full_outer")
    return joined.fillna(False, ["predicted", "actual"])


def user_day_sets(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    matched = match_truth(alerts, truth)
    p, a = F.col("predicted"), F.col("actual")
    return matched.agg(
        F.count_if(p & a).alias("both"),
        F.count_if(p & ~a).alias("alert_only"),
        F.count_if(~p & a).alias("truth_only"),
    )


def confusion(
    alerts: DataFrame,
    truth: DataFrame,
    severity_sets: Mapping[str, Sequence[str]] = SEVERITY_SETS,
) -> DataFrame:
    """tp, fp, fn and what follows from them, per set of severities, from one join.

    A user-day keeps the number of its alerts per severity; each set then sums its own.
    """
    names = sorted({s for group in severity_sets.values() for s in group})
    per_day = alerts.groupBy("user_key", "day").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in names]
    )
    actual = truth.select("user_key", "day").distinct().withColumn("actual", F.lit(True))
    days = per_day.join(actual, ["user_key", "day"], "full_outer").fillna(
        0, [f"n_{s}" for s in names]
    ).fillna(False, ["actual"])
    labels = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                sum((F.col(f"n_{s}") for s in group), F.lit(0)).alias("alerts"),
            )
            for label, group in severity_sets.items()
        ]
    )
    rows = days.select("actual", F.inline(labels))
    hit = F.col("alerts") > 0
    counted = rows.groupBy("label").agg(
        F.sum("alerts").alias("alerts"),
        F.count_if(hit & F.col("actual")).alias("tp"),
        F.count_if(hit & ~F.col("actual")).alias("fp"),
        F.count_if(~hit & F.col("actual")).alias("fn"),
    )
    return _rates(counted)


def _rates(counted: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    zero = F.lit(0.0)
    df = counted.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        }
    )
    return df.withColumns(
        {
            "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero),
            "fp_per_tp": F.try_divide(fp, tp),
        }
    )


def user_depth(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """Per malicious user with any alert: share of the malicious days that were alerted."""
    days = truth.select("user_key", "day").distinct().withColumn("bad", F.lit(True))
    per_day = alerts.groupBy("user_key", "day").agg(F.count(F.lit(1)).alias("n"))
    joined = per_day.join(days, ["user_key", "day"], "full_outer")
    users = joined.groupBy("user_key").agg(
        F.count("bad").alias("total_days"),
        F.count_if(F.col("bad") & F.col("n").isNotNull()).alias("detected_days"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"),
    )
    kept = users.where((F.col("total_days") > 0) & (F.col("alerts") > 0))
    rate = F.col("detected_days") / F.col("total_days")
    return kept.withColumns(
        {
            "rate": rate,
            "depth": F.when(rate == 1, "perfect").when(rate >= 0.8, "high").when(rate >= 0.5, "partial").otherwise("low"),
        }
    )


def monthly_counts(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    month = F.trunc("day", "MM")
    bad = truth.select("user_key", "day").distinct()
    a = bad.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("malicious"))
    b = alerts.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("alerts"))
    return a.join(b, "month", "full_outer").fillna(0)


def score_boost_stats(alerts: DataFrame) -> DataFrame:
    """Distribution of anomaly scores before and after the boost; one row."""
    e = F.col("evidence")
    mine = alerts.where(F.col("detector") == "anomaly").select(
        e["anomaly_score_raw"].alias("raw"),
        e["anomaly_score_boosted"].alias("boosted"),
        F.coalesce(e["boost_pct"], F.lit(0.0)).alias("boost"),
    )
    out = mine.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("raw").alias("raw_mean"),
        F.min("raw").alias("raw_min"),
        F.max("raw").alias("raw_max"),
        F.avg("boosted").alias("boosted_mean"),
        F.avg("boost").alias("boost_mean"),
        F.count_if(F.col("boost") > 0).alias("n_boosted"),
    )
    return out.withColumns(
        {
            "raw_median": F.lit(exact_quantiles(mine, "raw", [0.5], ["m"]).first()["m"]).cast("double"),
            "boosted_median": F.lit(exact_quantiles(mine, "boosted", [0.5], ["m"]).first()["m"]).cast("double"),
            "pct_boosted": F.try_divide(F.col("n_boosted") * 100.0, F.col("n")),
        }
    )


def pattern_coverage(alerts: DataFrame, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """How many alerts show each pattern in their evidence."""
    e = F.col("evidence")
    total = F.count(F.lit(1))
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("pattern"), F.count_if(F.coalesce(e[p], F.lit(0)) > 0).alias("n"), total.alias("total"))
            for p in patterns
        ]
    )
    flat = alerts.agg(rows.alias("rows")).select(F.inline("rows"))
    return flat.select("pattern", "n", F.try_divide(F.col("n") * 100.0, F.col("total")).alias("pct"))


# --- scores and labels -------------------------------------------------------------------


def score_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score from the top: true and false positives at that threshold."""
    measures = {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)}
    curve = running_totals(scored, score, measures, descending=True)
    positives = scored.agg(F.count_if((F.col(label) == 1) & F.col(score).isNotNull())).scalar()
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return curve.select(
        F.col(score).alias("threshold"),
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp, positives).alias("recall"),
    )


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row `roc_auc`: chance that a positive outranks a negative, ties counting half."""
    curve = score_curve(scored, score, label)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    sums = curve.agg(
        F.sum(pos).alias("p"),
        F.sum(neg).alias("n"),
        F.sum(pos * F.col("fp")).alias("below"),
        F.sum(pos * neg).alias("ties"),
    )
    pairs = F.col("p") * F.col("n")
    return sums.select(F.try_divide(pairs - F.col("below") + F.col("ties") / 2, pairs).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row `average_precision`: precision summed over steps of recall."""
    curve = score_curve(scored, score, label)
    return curve.agg(
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos").cast("double")).alias("average_precision")
    )


def precision_at_recall(
    scored: DataFrame,
    targets: Sequence[float] = RECALL_TARGETS,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Per target the best precision with at least that recall, and its highest threshold.

    `full_precision` is the precision at the lowest threshold, where recall is complete.
    """
    curve = score_curve(scored, score, label)
    rows = curve.select(
        "threshold", "precision", "recall", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    )
    reached = F.col("recall") >= F.col("target")
    best = F.max(F.when(reached, F.struct("precision", "threshold")))
    out = rows.groupBy("target").agg(best.alias("b"), F.min_by("precision", "threshold").alias("full_precision"))
    return out.select("target", "b.precision", "b.threshold", "full_precision")


def percentile_volume(
    scored: DataFrame,
    percentiles: Sequence[float] = VOLUME_PERCENTILES,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Alerts and hits at thresholds taken from percentiles of the scores."""
    names = [f"q{i}" for i in range(len(percentiles))]
    cuts = exact_quantiles(scored, score, [p / 100 for p in percentiles], names)
    table = cuts.select(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(n).alias("threshold")) for p, n in zip(percentiles, names)]))
    rows = scored.select(score, label, F.inline(table.scalar()))
    hit = F.col(score) >= F.col("threshold")
    counted = rows.groupBy("pct", "threshold").agg(
        F.count_if(hit).alias("alerts"),
        F.count_if(hit & (F.col(label) == 1)).alias("tp"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    return counted.select(
        "pct",
        "threshold",
        "alerts",
        "tp",
        F.coalesce(F.try_divide("tp", "alerts"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("recall"),
    )


def class_report(scored: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    predicted = (F.col(score) >= threshold).cast("int")
    cells = scored.groupBy(F.col(label).alias("actual"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    is_actual, is_predicted = F.col("actual") == F.col("class"), F.col("predicted") == F.col("class")
    counted = rows.groupBy("class").agg(
        total(is_actual & is_predicted).alias("tp"),
        total(~is_actual & is_predicted).alias("fp"),
        total(is_actual & ~is_predicted).alias("fn"),
        total(is_actual).alias("support"),
    )
    return _rates(counted).select("class", "precision", "recall", "f1", "support")


# --- lead times --------------------------------------------------------------------------


def exfil_in_split(ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """(user_key, exfil_start) of the labelled users that have windows."""
    users = windows.select("user_key").distinct()
    return ranges.join(users, "user_key", "left_semi").groupBy("user_key").agg(
        F.min("exfil_start").alias("exfil_start")
    )


def lead_times(scored: DataFrame, ranges: DataFrame, threshold: float) -> DataFrame:
    """Per labelled user the first flagged window up to the start, and the days between."""
    starts = exfil_in_split(ranges, scored)
    joined = starts.join(scored.select("user_key", "end_day", "score"), "user_key")
    flagged = (F.col("end_day") <= F.col("exfil_start")) & (F.col("score") >= threshold)
    users = joined.groupBy("user_key", "exfil_start").agg(
        F.min(F.when(flagged, F.col("end_day"))).alias("first_flag")
    )
    return users.withColumns(
        {
            "lead_time_days": F.date_diff("exfil_start", "first_flag").cast("bigint"),
            "detected": F.col("first_flag").isNotNull(),
        }
    )


def lead_time_stats(leads: DataFrame) -> DataFrame:
    out = leads.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if("detected").alias("n_detected"),
        F.min("lead_time_days").alias("lead_min"),
        F.max("lead_time_days").alias("lead_max"),
        F.avg("lead_time_days").alias("lead_mean"),
    )
    return out.withColumns(
        {
            "detection_rate": F.coalesce(F.try_divide("n_detected", "n_users"), F.lit(0.0)),
            "lead_median": exact_quantiles(leads, "lead_time_days", [0.5], ["m"]).scalar(),
        }
    )
