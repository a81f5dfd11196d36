"""Deviation of a window score from the user's own and the user's groups' earlier scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import staged

# Windows a group must have behind it before it serves as a baseline.
GROUP_MINIMUM = {
    "role_id": 50,
    "business_unit": 30,
    "functional_unit": 30,
    "department": 30,
    "team_id": 20,
}
# Column prefix of each group's baseline; the role drops its suffix.
GROUP_PREFIX = {**{g: g for g in GROUP_MINIMUM}, "role_id": "role"}
Z_COLUMNS = ("z_personal", *[f"z_{p}" for p in GROUP_PREFIX.values()])


def attach_org(scores: DataFrame, org: DataFrame) -> DataFrame:
    """Organisation columns by user; `org` has one row per user, so no score is repeated."""
    return scores.join(org, "user_key", "left")


def personal_baseline(scores: DataFrame, min_prior: int = 14) -> DataFrame:
    """Mean and sample deviation of the user's earlier scores, and the z-score against them."""
    prior = (
        Window.partitionBy("user_key")
        .orderBy("end_day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    score = F.col("base_score")
    df = scores.withColumns(
        {
            "prior_window_count": F.count(F.lit(1)).over(prior),
            "__mean": F.avg(score).over(prior),
            "__std": F.stddev_samp(score).over(prior),
        }
    )
    enough = F.col("prior_window_count") >= min_prior
    return df.withColumns(
        {
            "personal_mean": F.when(enough, F.col("__mean")),
            "personal_std": F.when(enough, F.col("__std")),
            "z_personal": F.when(enough, F.try_divide(score - F.col("__mean"), F.col("__std"))),
        }
    ).drop("__mean", "__std")


def prior_moments(daily: DataFrame, keys: Sequence[str], order: str = "end_day") -> DataFrame:
    """(keys, order, n_prior, mean, std) over all earlier rows of each key, merged as central moments.

    `daily` has `n`, the mean `m` and the squared spread `within` of a day. Merging a day into
    what came before adds its spread and n * N / (N + n) times the square of its distance from
    the mean so far; all terms are positive, so nothing cancels, however large the mean is
    beside the deviation. Means are summed as distances from the key's first one.
    """
    line = Window.partitionBy(*keys).orderBy(order)
    prior = line.rowsBetween(Window.unboundedPreceding, -1)
    n, m = F.col("n"), F.col("m")
    run = daily.withColumn("__first", F.first("m", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.withColumns(
        {
            "n_prior": F.coalesce(F.sum("n").over(prior), F.lit(0)),
            "__far": F.sum(n * (m - F.col("__first"))).over(prior),
        }
    )
    run = run.withColumn("mean", F.col("__first") + F.try_divide(F.col("__far"), F.col("n_prior")))
    before = F.col("n_prior")
    grown = F.col("within") + F.coalesce((m - F.col("mean")) * (m - F.col("mean")) * n * before / (before + n), F.lit(0.0))
    spread = F.sum(grown).over(prior)
    return run.select(*keys, order, "n_prior", "mean", F.sqrt(F.try_divide(spread, before - 1)).alias("std"))


def group_baselines(scores: DataFrame, minimum: dict[str, int] | None = None) -> DataFrame:
    """Mean and sample deviation of all scores of each group on strictly earlier days.

    Scores are first reduced to count, mean and squared spread per (group, day), all kinds of
    groups in one aggregation; `prior_moments` of those days follow, so a group holding a
    third of all users costs as many rows as it has days. The baselines, a row per group and
    day, are staged and looked up by a join for each kind of group, which broadcasts them as
    long as they are below Spark's limit. Rows that repeat stay repeated.
    """
    minimum = GROUP_MINIMUM if minimum is None else minimum
    score = F.col("base_score")
    kinds = F.array(
        *[F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("value")) for g in minimum]
    )
    daily = (
        scores.select("end_day", "base_score", F.inline(kinds))
        .where(F.col("value").isNotNull())
        .groupBy("kind", "value", "end_day")
        .agg(
            F.count(score).alias("n"),
            # The mean of equal scores is that score, not a rounded sum.
            F.when(F.min(score) == F.max(score), F.min(score)).otherwise(F.avg(score)).alias("m"),
            (F.var_pop(score) * F.count(score)).alias("within"),
        )
    )
    base = staged(prior_moments(daily, ("kind", "value")), "group-baselines")
    found = scores
    for group, need in minimum.items():
        p = GROUP_PREFIX.get(group, group)
        enough = F.col("n_prior") >= need
        side = base.where(F.col("kind") == group).select(
            F.col("value").alias("__value"), F.col("end_day").alias("__day"), F.col("n_prior").alias(f"{p}_n"),
            F.when(enough, F.col("mean")).alias(f"{p}_mean"), F.when(enough, F.col("std")).alias(f"{p}_std"),
        )
        match = (F.col(group).cast("string") == F.col("__value")) & (F.col("end_day") == F.col("__day"))
        found = found.join(side, match, "left").drop("__value", "__day")
        found = found.withColumn(f"z_{p}", F.try_divide(score - F.col(f"{p}_mean"), F.col(f"{p}_std")))
    return found


def group_baseline(scores: DataFrame, group: str, min_windows: int | None = None) -> DataFrame:
    """`group_baselines` for one kind of group."""
    need = GROUP_MINIMUM.get(group, 30) if min_windows is None else min_windows
    return group_baselines(scores, {group: need})


def max_z(scores: DataFrame, columns: tuple[str, ...] = Z_COLUMNS) -> DataFrame:
    return scores.withColumn("z_max", F.greatest(*[F.col(c) for c in columns]))


def all_baselines(
    scores: DataFrame, min_prior: int = 14, minimum: dict[str, int] | None = None
) -> DataFrame:
    """Personal, role and organisation baselines with `z_max`; `scores` carries the groups."""
    df = group_baselines(personal_baseline(scores, min_prior), minimum)
    return max_z(df)


def attach_z(scores: DataFrame, z: DataFrame) -> DataFrame:
    side = z.select("user_key", "end_day", "z_personal", "z_role", "z_max")
    return scores.join(side, ["user_key", "end_day"], "left")
