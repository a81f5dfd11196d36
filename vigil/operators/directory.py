"""The employee directory: monthly snapshots, bounds, supervisors, organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import text, times
from vigil.operators.enrich import expect_none, latest

ORG_COLUMNS = ("role_id", "business_unit", "functional_unit", "department", "team_id")


def snapshots(raw: DataFrame) -> DataFrame:
    """One row per user and month; of several, the last one read.

    `raw` carries `snapshot_date`, `user_key`, the attributes and, where the source knows it,
    `read_order` to tell which row came last; attributes break what ties are left.
    """
    attrs = [c for c in raw.columns if c not in ("user_key", "snapshot_date", "read_order")]
    order = [F.col("read_order").desc()] if "read_order" in raw.columns else []
    order += [F.col(c).desc_nulls_last() for c in attrs]
    kept = latest(raw, ["user_key", "snapshot_date"], order).drop("read_order")
    if "email" in kept.columns:
        kept = kept.withColumn("email", text.blank_to_null(text.norm_text(F.col("email"))))
        kept = kept.withColumn("email_domain", text.email_domain(F.col("email")))
    if "role" in kept.columns:
        kept = kept.withColumn("role", F.trim(F.col("role")))
    return kept


def as_of_months(snaps: DataFrame) -> DataFrame:
    """Snapshots keyed by (user_key, event_month)."""
    month = times.month_start(F.col("snapshot_date"))
    keyed = snaps.withColumn("event_month", month).drop("snapshot_date")
    return keyed.dropDuplicates(["user_key", "event_month"])


def seen_bounds(directory: DataFrame) -> DataFrame:
    return directory.groupBy("user_key").agg(
        F.min("event_month").alias("first_seen"), F.max("event_month").alias("last_seen")
    )


def attach_seen(directory: DataFrame) -> DataFrame:
    return directory.join(seen_bounds(directory), "user_key", "left")


def supervisor_map(directory: DataFrame) -> DataFrame:
    """(event_month, name) -> user_key; of several bearers of a name the first key wins."""
    named = directory.select(
        "event_month", text.norm_name(F.col("employee_name")).alias("name"), "user_key"
    ).where(F.col("name").isNotNull())
    return named.groupBy("event_month", "name").agg(F.min("user_key").alias("supervisor_key"))


def resolve_supervisor(directory: DataFrame) -> DataFrame:
    """`supervisor_key` by name within the month; a supervisor with an `@` fails the job."""
    name = text.norm_name(F.col("supervisor"))
    guarded = expect_none(
        directory, F.contains(name, F.lit("@")), "supervisor holds an address; names are required"
    )
    keyed = guarded.withColumn("name", text.norm_name(F.col("supervisor")))
    # Rows without a supervisor match nothing; the spread keeps them from meeting in one task.
    keyed = keyed.withColumn("spread", F.when(F.col("name").isNull(), F.pmod(F.xxhash64("user_key"), F.lit(256))).otherwise(0))
    named = supervisor_map(directory).withColumn("spread", F.lit(0).cast("long"))
    return keyed.join(named, ["event_month", "name", "spread"], "left").drop("name", "spread")


def build_directory(raw: DataFrame) -> DataFrame:
    """From raw snapshots to the complete as-of table."""
    table = attach_seen(resolve_supervisor(as_of_months(snapshots(raw))))
    return table.withColumn("is_admin", text.is_admin(F.col("role")))


def user_org(directory: DataFrame) -> DataFrame:
    """Organisation of each user by the latest month that has a role; one row per user."""
    placed = directory.where(F.col("role").isNotNull())
    newest = placed.groupBy("user_key").agg(
        F.max_by(
            F.struct(
                F.col("role").alias("role_id"),
                "business_unit",
                "functional_unit",
                "department",
                F.col("team").alias("team_id"),
            ),
            "event_month",
        ).alias("org")
    )
    return newest.select("user_key", "org.*")


def termination_map(directory: DataFrame) -> DataFrame:
    """Last month of each user, and whether it lies before the end of the data."""
    last = directory.groupBy("user_key").agg(F.max("event_month").alias("last_seen"))
    end = directory.agg(F.max("event_month")).scalar()
    return last.withColumn("is_terminated", F.col("last_seen") < end)


def attach_termination(daily: DataFrame, term: DataFrame) -> DataFrame:
    """`is_post_departure`: the day lies after the last month of a user who left."""
    gone = term.where("is_terminated").select("user_key", F.col("last_seen").alias("__gone"))
    joined = daily.join(gone, "user_key", "left")
    after = F.coalesce(F.col("day") > F.col("__gone"), F.lit(False))
    return joined.withColumn("is_post_departure", after).drop("__gone")
