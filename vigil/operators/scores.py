"""Analysis of window scores: distribution, roles, deciles, known insiders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.ordering import exact_quantiles

# Daily columns whose means describe a group of windows.
PROFILE_FEATURES = {
    "avg_logons": "logon_n_logon",
    "avg_usb": "device_n_usb_connects",
    "avg_wikileaks": "http_n_wikileaks",
    "avg_files": "file_n_file_events",
    "avg_emails": "email_n_email_sent",
    "avg_after_hours": "logon_after_hours_rate",
    "avg_device_after_hours": "device_after_hours_rate",
}


def score_distribution(scores: DataFrame) -> DataFrame:
    s = F.col("base_score")
    out = scores.agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.countDistinct("user_key").alias("unique_users"),
        F.min("end_day").alias("first_day"),
        F.max("end_day").alias("last_day"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.avg(s).alias("mean_score"),
    )
    names = ["p25", "median_score", "p75"]
    cuts = exact_quantiles(scores, "base_score", [0.25, 0.5, 0.75], names)
    found = cuts.first()
    return out.select("*", *[F.lit(found[n]).cast("double").alias(n) for n in names])


def group_stats(scores: DataFrame, by: str = "role_id") -> DataFrame:
    s = F.col("base_score")
    return scores.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("num_windows"),
        F.avg(s).alias("avg_score"),
        F.stddev_samp(s).alias("std_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
    )


def user_vs_group(user_stats: DataFrame, group_stat: DataFrame, by: str = "role_id") -> DataFrame:
    return user_stats.join(group_stat, by)


def user_vs_role(scores: DataFrame, by: str = "role_id") -> DataFrame:
    """Mean of each user against the mean and deviation of all windows of the role.

    Role figures come from the per-user sums, so the scores are read once.
    """
    s = F.col("base_score")
    users = scores.where(F.col(by).isNotNull()).groupBy("user_key", by).agg(
        F.avg(s).alias("user_avg_score"),
        F.count(F.lit(1)).alias("num_windows"),
    )
    roles = group_stats(scores, by).select(
        by, F.col("avg_score").alias("role_avg_score"), F.col("std_score").alias("__std")
    )
    joined = user_vs_group(users, roles.where(F.col("__std") > 0), by)
    z = F.try_divide(F.col("user_avg_score") - F.col("role_avg_score"), F.col("__std"))
    return joined.withColumn("z_score_vs_role", z).drop("__std")


def top_windows(scores: DataFrame, n: int = 20) -> DataFrame:
    return scores.orderBy(F.col("base_score").desc(), "user_key", "end_day").limit(n)


def top_outliers(stats: DataFrame, n: int = 15) -> DataFrame:
    return stats.orderBy(F.col("z_score_vs_role").desc_nulls_last(), "user_key").limit(n)


def top_roles(stats: DataFrame, n: int = 20, by: str = "role_id") -> DataFrame:
    return stats.orderBy(F.col("avg_score").desc(), by).limit(n)


def top_users_overlap(scores: DataFrame, insiders: DataFrame, n: int = 100) -> DataFrame:
    """Users behind the `n` highest windows, and whether each is a known insider."""
    users = top_windows(scores, n).select("user_key").distinct()
    known = insiders.select("user_key").distinct().withColumn("__known", F.lit(True))
    joined = users.join(known, "user_key", "left")
    return joined.select("user_key", F.coalesce("__known", F.lit(False)).alias("is_insider"))


def windows_to_days(windows: DataFrame, daily: DataFrame, n: int = 14) -> DataFrame:
    """Every (window, day) pair of the `n` calendar days that end with the window."""
    side = windows.select(F.col("user_key").alias("__user"), "end_day")
    match = (
        (F.col("user_key") == F.col("__user"))
        & (F.col("day") <= F.col("end_day"))
        & (F.col("day") > F.date_sub("end_day", n))
    )
    return daily.join(side, match).drop("__user")


def decile_profile(
    scores: DataFrame,
    daily: DataFrame,
    n: int = 14,
    features: dict[str, str] = PROFILE_FEATURES,
) -> DataFrame:
    """Mean daily features of the windows in the top and in the bottom tenth of scores.

    A day counts once for every such window that covers it. Counting the covering windows
    with a range frame gives that weight directly, so no window-day pairs are made.
    """
    cuts = exact_quantiles(scores, "base_score", [0.9, 0.1], ["hi", "lo"])
    cut = cuts.select(F.struct("hi", "lo")).scalar()
    flagged = scores.select(
        "user_key",
        F.col("end_day").alias("day"),
        (F.col("base_score") >= cut["hi"]).cast("int").alias("high"),
        (F.col("base_score") <= cut["lo"]).cast("int").alias("low"),
    )
    days = daily.select("user_key", "day", *features.values()).withColumn("__row", F.lit(1))
    line = days.unionByName(flagged, allowMissingColumns=True)
    ahead = Window.partitionBy("user_key").orderBy(F.expr("unix_date(day)")).rangeBetween(0, n - 1)
    covered = line.select(
        "__row",
        *features.values(),
        F.coalesce(F.sum("high").over(ahead), F.lit(0)).alias("w_high"),
        F.coalesce(F.sum("low").over(ahead), F.lit(0)).alias("w_low"),
    ).where("__row = 1")

    def mean(weight: str, column: str) -> Column:
        w = F.col(weight)
        known = F.when(F.col(column).isNotNull(), w)
        return F.try_divide(F.sum(w * F.col(column)).cast("double"), F.sum(known))

    groups = {"HIGH_SCORE": "w_high", "LOW_SCORE": "w_low"}
    rows = F.array(
        *[
            F.struct(F.lit(g).alias("group_type"), *[mean(w, c).alias(name) for name, c in features.items()])
            for g, w in groups.items()
        ]
    )
    return covered.agg(rows.alias("rows")).select(F.inline("rows"))


def profile_difference(profile: DataFrame, features: dict[str, str] = PROFILE_FEATURES) -> DataFrame:
    """High minus low per feature, and in percent of low (0 where low is not positive)."""
    def of(group: str, name: str) -> Column:
        return F.max(F.when(F.col("group_type") == group, F.col(name)))

    rows = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), of("HIGH_SCORE", n).alias("high"), of("LOW_SCORE", n).alias("low"))
            for n in features
        ]
    )
    flat = profile.agg(rows.alias("rows")).select(F.inline("rows"))
    diff = F.col("high") - F.col("low")
    return flat.select(
        "feature", diff.alias("diff"),
        F.when(F.col("low") > 0, diff / F.col("low") * 100).otherwise(0.0).alias("pct_change"),
    )


def stack_cohorts(high: DataFrame, low: DataFrame) -> DataFrame:
    return high.unionByName(low)


def insider_stats(scores: DataFrame, insiders: DataFrame) -> DataFrame:
    """Scores of known insiders, over all their windows and within the attack range."""
    joined = insiders.join(scores, "user_key", "left")
    s = F.col("base_score")
    attack = F.when(F.col("end_day").between(F.col("start"), F.col("end")), s)
    return joined.groupBy("user_key", "scenario", "start", "end").agg(
        F.count(s).alias("num_windows"),
        F.avg(s).alias("avg_score"),
        F.max(s).alias("max_score"),
        F.min(s).alias("min_score"),
        F.count(attack).alias("attack_windows"),
        F.avg(attack).alias("attack_avg_score"),
        F.max(attack).alias("attack_max_score"),
    )


def window_indicators(scores: DataFrame, daily: DataFrame, k: int = 1, n: int = 14, min_usb: int = 10) -> DataFrame:
    """What happened in the `k` highest windows, and whether it looks like exfiltration."""
    top = top_windows(scores, k).select("user_key", "end_day", "base_score")
    rows = windows_to_days(top, daily, n)
    totals = rows.groupBy("user_key", "end_day").agg(
        F.coalesce(F.sum("device_n_usb_connects"), F.lit(0)).alias("total_usb"),
        F.coalesce(F.sum("http_n_wikileaks"), F.lit(0)).alias("total_wikileaks"),
        F.coalesce(F.sum("file_n_file_events"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("email_n_email_sent"), F.lit(0)).alias("total_emails"),
        F.avg("logon_after_hours_rate").alias("avg_after_hours"),
    )
    possible = (F.col("total_wikileaks") > 0) | (F.col("total_usb") > min_usb)
    return totals.withColumn("possible_exfiltration", possible)
