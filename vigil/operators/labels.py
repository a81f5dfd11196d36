"""Label ranges, daily and forecast labels, user splits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.ordering import running_totals
from vigil.operators.rolling import by_user, number_history

SCENARIO = "SCENARIO_1"


def exfil_ranges(truth: DataFrame, scenario: str = SCENARIO) -> DataFrame:
    """First and last truth day per user; `truth` has `user_key` and `ts`."""
    day = F.col("ts").cast("date")
    ranges = truth.groupBy("user_key").agg(
        F.min(day).alias("exfil_start"), F.max(day).alias("exfil_end")
    )
    return ranges.withColumn("scenario_id", F.lit(scenario))


def exfil_start(ranges: DataFrame, scenario: str = SCENARIO) -> DataFrame:
    mine = ranges.where(F.col("scenario_id") == scenario)
    return mine.groupBy("user_key").agg(F.min("exfil_start").alias("exfil_start"))


def _range_state(daily: DataFrame, ranges: DataFrame) -> DataFrame:
    """`daily` with `is_exfil_day` and `days_until_exfil`.

    Days and range starts are merged into one line per user: a day lies in some range when
    the furthest end among the ranges begun so far has not passed, and the next start is the
    smallest one after it. One shuffle on the user, no pairs of days and ranges.
    """
    marks = ranges.select(
        "user_key",
        F.col("exfil_start").cast("date").alias("day"),
        F.col("exfil_end").cast("date").alias("__end"),
        F.lit(True).alias("__mark"),
    )
    days = daily.withColumn("__mark", F.lit(False))
    line = days.unionByName(marks, allowMissingColumns=True)
    begun = by_user().rangeBetween(Window.unboundedPreceding, 0)
    later = (
        Window.partitionBy("user_key")
        .orderBy(-F.expr("unix_date(day)"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    next_start = F.min(F.when(F.col("__mark"), F.col("day"))).over(later)
    state = line.withColumns(
        {
            "is_exfil_day": F.coalesce(F.max("__end").over(begun) >= F.col("day"), F.lit(False)),
            "days_until_exfil": F.date_diff(next_start, F.col("day")).cast("bigint"),
        }
    )
    return state.where(~F.col("__mark")).drop("__mark", "__end")


def label_days(daily: DataFrame, ranges: DataFrame) -> DataFrame:
    """`label`: 1 inside any range of the user, else 0."""
    state = _range_state(daily, ranges).drop("days_until_exfil")
    return state.withColumn("label", F.col("is_exfil_day").cast("int")).drop("is_exfil_day")


def forecast_labels(
    daily: DataFrame, ranges: DataFrame, horizon: int = 7, scenario: str = SCENARIO
) -> DataFrame:
    """NULL inside a range, 1 within `horizon` days before the next one, else 0."""
    state = _range_state(daily, ranges.where(F.col("scenario_id") == scenario))
    ahead = F.coalesce(F.col("days_until_exfil").between(1, horizon), F.lit(False))
    return state.withColumns(
        {
            "forecast_horizon_days": F.lit(horizon),
            "label_forecast_day": F.when(~F.col("is_exfil_day"), ahead.cast("int")),
        }
    )


def attach_flags(daily: DataFrame, flags: DataFrame) -> DataFrame:
    return daily.join(flags, ["user_key", "day"], "left")


def user_split(
    daily: DataFrame, seed: int = 42, parts: tuple[float, float, float] = (0.70, 0.15, 0.15)
) -> DataFrame:
    """Users into train, val and test by a hash of seed and key: stable under any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("user_key")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    train, val = round(parts[0] * 100), round((parts[0] + parts[1]) * 100)
    split = F.when(bucket < train, "train").when(bucket < val, "val").otherwise("test")
    return daily.select("user_key").distinct().withColumn("split", split)


def user_split_exact(
    daily: DataFrame, seed: int = 42, parts: tuple[float, float, float] = (0.70, 0.15, 0.15)
) -> DataFrame:
    """As `user_split`, but with exactly int(n * share) users: by rank of the hash, then the key.

    Shares are taken as the decimals they are written as, so a whole n * share is not rounded down.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("user_key")))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    # A user without a key comes last, as a place after all others.
    rank_key = F.struct(F.coalesce(place, F.lit(2**62)).alias("place"), "user_key").alias("place")
    users = daily.select("user_key").distinct().select(rank_key)
    ranks = running_totals(users, "place", {"n": F.count(F.lit(1))})
    n = users.agg(F.count(F.lit(1))).scalar()
    first, second = (Decimal(str(part)) for part in parts[:2])
    train, val = F.floor(n * F.lit(first)), F.floor(n * F.lit(first + second))
    rank = F.col("cum_n")
    split = F.when(rank <= train, "train").when(rank <= val, "val").otherwise("test")
    return ranks.select("place.user_key", split.alias("split"))


def attach_split(days: DataFrame, splits: DataFrame) -> DataFrame:
    return days.join(splits.select("user_key", "split").distinct(), "user_key")


def forecast_windows(labels: DataFrame, splits: DataFrame, min_history: int = 14) -> DataFrame:
    """(user_key, end_day, label, split) of labelled days with enough labelled history."""
    known = labels.where(F.col("label_forecast_day").isNotNull()).select(
        "user_key", "day", F.col("label_forecast_day").alias("label")
    )
    numbered = number_history(attach_split(known, splits))
    return numbered.where(F.col("rn") >= min_history).select(
        "user_key", F.col("day").alias("end_day"), "label", "split"
    )


def attach_windows(labels: DataFrame, windows: DataFrame) -> DataFrame:
    return labels.join(windows.select("user_key", "end_day", "window"), ["user_key", "end_day"])


def split_rates(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("label").alias("n_pos"),
        F.avg(F.col("label").cast("double")).alias("pos_rate"),
    )


def label_audit(labels: DataFrame) -> DataFrame:
    label = F.col("label_forecast_day")
    return labels.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(label == 1).alias("positive_labels"),
        F.count_if(label == 0).alias("negative_labels"),
        F.count_if(label.isNull()).alias("null_labels"),
        F.countDistinct("user_key").alias("total_users"),
        F.countDistinct(F.when(label == 1, F.col("user_key"))).alias("users_with_positives"),
    )


def probe_users(labels: DataFrame, users: DataFrame) -> DataFrame:
    """The positive days of the users to be looked at."""
    positive = labels.where(F.col("label_forecast_day") == 1)
    few = positive.join(users.select("user_key").distinct(), "user_key", "left_semi")
    return few.select("user_key", "day", "label_forecast_day", "is_exfil_day", "days_until_exfil")


def class_weight(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row `weight`: negatives per positive."""
    neg = F.count_if(F.col(label) == 0)
    pos = F.count_if(F.col(label) == 1)
    return labels.agg(neg.alias("neg"), pos.alias("pos"), F.try_divide(neg, pos).alias("weight"))
