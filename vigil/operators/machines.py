"""Shared machines and the machine each user normally works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import times


def pc_sharedness(logon: DataFrame) -> DataFrame:
    """Most distinct users a machine had in one month.

    Distinct (pc, month, user) first, so a machine everyone uses is spread over its users.
    """
    seen = logon.where(F.col("pc").isNotNull()).select("pc", "event_month", "user_key").distinct()
    monthly = seen.groupBy("pc", "event_month").agg(F.count("user_key").alias("users"))
    return monthly.groupBy("pc").agg(F.max("users").alias("distinct_non_admin_users"))


def pc_dominance(logon: DataFrame) -> DataFrame:
    """Share of a machine's events that its busiest user made."""
    pairs = logon.where(F.col("pc").isNotNull()).groupBy("pc", "user_key").agg(
        F.count(F.lit(1)).alias("events")
    )
    return pairs.groupBy("pc").agg(
        (F.max("events") / F.sum("events")).alias("top_user_share")
    )


def choose_shared(
    sharedness: DataFrame, lo: int = 95, hi: int = 120, top: int = 100
) -> DataFrame:
    """Machines at or above the largest K that leaves between `lo` and `hi` of them,
    else exactly the `top` most shared.

    Only the first max(hi, top) + 1 machines can decide this, so a top-k is taken first and
    everything after it handles that many rows, however large the fleet is.
    """
    metric = F.col("distinct_non_admin_users")
    head = sharedness.orderBy(metric.desc(), "pc").limit(max(hi, top) + 1)
    ranked = head.select(
        "pc",
        "distinct_non_admin_users",
        F.row_number().over(Window.orderBy(metric.desc(), "pc")).alias("rank"),
        F.count(F.lit(1)).over(
            Window.orderBy(metric.desc()).rangeBetween(Window.unboundedPreceding, 0)
        ).alias("at_least"),
    )
    in_band = F.when(F.col("at_least").between(lo, hi), metric)
    whole = Window.partitionBy(F.lit(1))
    chosen = ranked.withColumn("k", F.max(in_band).over(whole))
    keep = F.when(F.col("k").isNotNull(), metric >= F.col("k")).otherwise(F.col("rank") <= top)
    return chosen.where(keep).select("pc", "distinct_non_admin_users")


def shared_pcs(logon: DataFrame, lo: int = 95, hi: int = 120, top: int = 100) -> DataFrame:
    """(pc, distinct_non_admin_users, top_user_share, shared_pc) from logons without admins."""
    chosen = choose_shared(pc_sharedness(logon), lo, hi, top)
    wanted = logon.join(chosen.select("pc"), "pc", "left_semi")
    joined = chosen.join(pc_dominance(wanted), "pc", "left")
    return joined.withColumn("shared_pc", F.lit(True))


def assigned_pc(
    logon: DataFrame, shared: DataFrame, min_days: int = 5, min_share: float = 0.5
) -> DataFrame:
    """The machine with most business-hour days per user, NULL where it is not stable.

    `logon` are logon events, or their `pc_day_counts` with `n_business_hours`.
    `user_days` is the sum over machines, as a day on two machines counts for both.
    """
    counted = "n_business_hours" in logon.columns
    working = F.col("n_business_hours") > 0 if counted else times.business_hours(F.col("timestamp"))
    usual = logon.where(F.col("pc").isNotNull() & working)
    own = usual.join(shared.select("pc"), "pc", "left_anti")
    day = F.col("day") if counted else times.day(F.col("timestamp")).alias("day")
    days = own.select("user_key", "pc", day).distinct()
    per_pc = days.groupBy("user_key", "pc").agg(F.count("day").alias("days_on_pc"))
    best = per_pc.groupBy("user_key").agg(
        F.min(F.struct((-F.col("days_on_pc")).alias("neg"), F.col("pc").alias("pc"))).alias("best"),
        F.sum("days_on_pc").alias("user_days"),
    )
    share = -F.col("best.neg") / F.col("user_days")
    stable = (F.col("user_days") >= min_days) & (share >= min_share)
    return best.select(
        "user_key",
        F.when(stable, F.col("best.pc")).alias("assigned_pc"),
        (-F.col("best.neg")).alias("days_on_pc"),
        "user_days",
        share.alias("share"),
    )


def preview(df: DataFrame, order: list, n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)
