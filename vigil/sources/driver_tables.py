"""The driver's tables in the shape of our inputs (FIXTURES.md, section 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import text, times
from vigil.operators.enrich import with_url_columns

# Which event type plays which domain, and what we call inside and personal.
DOMAIN_OF_TYPE = {
    "signup": "logon",
    "error": "device",
    "click": "file",
    "view": "http",
    "purchase": "email",
}
INTERNAL_DOMAINS = ("corp.example",)
PERSONAL_DOMAINS = ("gmail.com",)
JOB_HOSTS = ("hirepath.com",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files as they are now: a kept DataFrame would go on with the list of its first use."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_type(c: Column) -> Column:
    pairs = [F.lit(x) for pair in DOMAIN_OF_TYPE.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def event_columns(events: DataFrame) -> DataFrame:
    """Event rows as activity: keys, machine, URL and addresses, before any flag."""
    k, uid = F.col("k"), F.col("user_id")
    keyed = events.select(
        "event_id",
        "user_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user_key"),
        _by_type(F.col("event_type")).alias("domain"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    machine = (
        F.when(k >= 90, F.concat(F.lit("lab-"), k % 3))
        .when(k < 70, F.concat(F.lit("pc-"), uid))
        .otherwise(F.concat(F.lit("pc-"), (uid + k) % 15))
    )
    site = (
        F.when(k % 11 == 0, "www.wikileaks.org")
        .when(k % 13 == 0, "dl.dropboxusercontent.com")
        .when(k % 17 == 0, "jobs.hirepath.com")
        .otherwise("intra.corp.example")
    )
    page = F.when(k % 3 == 0, "").when(k % 3 == 1, "a/").otherwise("a/b.html")
    http, mail = F.col("domain") == "http", F.col("domain") == "email"
    sender = F.when((k % 4) < 2, F.concat("user_key", F.lit("@corp.example"))).otherwise(
        F.concat("user_key", F.lit("@partner.example"))
    )
    to = F.when(k % 2 == 0, "desk@mail.corp.example").otherwise("b@vendor.example")
    activity = F.when(
        F.col("domain") == "device",
        F.when(F.col("event_id") % 2 == 0, "connect").otherwise("disconnect"),
    ).when(F.col("domain") == "file", F.when(k % 2 == 0, "file open").otherwise("file write"))
    return keyed.select(
        "*",
        machine.alias("pc"),
        activity.alias("activity"),
        F.when(http, F.concat(F.lit("https://"), site, F.lit("/"), page)).alias("url"),
        F.when(mail, sender).alias("from"),
        F.when(mail, to).alias("to"),
        F.when(mail & (k % 7 == 0), "me@gmail.com").alias("cc"),
        F.when(mail, (k % 4).cast("string")).alias("attachments"),
    )


def activity(spark: SparkSession, sf_dir: str, domain: str | Sequence[str] | None = None) -> DataFrame:
    """All five domains in one table with every row-level flag, or one or some of the domains.

    Domains are filtered by their event types, which the parquet scan can use.
    """
    events = table(spark, sf_dir, "events")
    if domain is not None:
        wanted = [domain] if isinstance(domain, str) else list(domain)
        kinds = [t for t, d in DOMAIN_OF_TYPE.items() if d in wanted]
        events = events.where(F.col("event_type").isin(kinds))
    return with_flags(event_columns(events))


def with_flags(df: DataFrame) -> DataFrame:
    k, file, mail = F.col("k"), F.col("domain") == "file", F.col("domain") == "email"
    addressed = df.withColumn(
        "__domains", F.when(mail, text.recipient_domains([F.col("to"), F.col("cc")]))
    )
    flags = text.direction_flags(F.col("from"), F.col("__domains"), INTERNAL_DOMAINS, PERSONAL_DOMAINS)
    flagged = addressed.withColumns(
        {
            "day": times.day(F.col("timestamp")),
            "event_month": times.month_start(F.col("timestamp")),
            "after_hours": times.after_hours(F.col("timestamp")),
            "to_removable_media": file & (k % 3 == 0),
            "from_removable_media": file & (k % 5 == 0),
            "is_keylogger": file & (k == 7),
            "attachment_count": text.attachment_count(F.col("attachments")),
            **{n: F.when(mail, c).otherwise(False) for n, c in flags.items()},
        }
    )
    return with_url_columns(flagged.drop("__domains"), JOB_HOSTS)


def logons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logon events with the columns the machine operators need."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return event_columns(events).select(
        "user_key",
        "timestamp",
        times.month_start(F.col("timestamp")).alias("event_month"),
        "pc",
    )


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory of the users of `events`: one month per user, bounds as in FIXTURES.md.

    Every seventh user left before the events begin.
    """
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("c_custkey")
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    return placed.select(
        F.concat(F.lit("u"), key).alias("user_key"),
        F.lit("2023-01-01").cast("date").alias("first_seen"),
        F.when(key % 7 == 0, F.lit("2023-12-01")).otherwise(F.lit("2024-06-01")).cast("date").alias("last_seen"),
        F.col("c_name").alias("employee_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "ITAdmin").otherwise(F.col("c_mktsegment")).alias("role"),
        F.col("r_name").alias("business_unit"),
        F.concat(F.lit("fu-"), key % 6).alias("functional_unit"),
        F.col("n_name").alias("department"),
        F.concat(F.lit("team-"), key % 10).alias("team"),
    )


def event_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_users(spark, sf_dir).select(
        "user_key", F.col("role").alias("role_id"), "business_unit", "functional_unit",
        "department", F.col("team").alias("team_id"),
    )


def directory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw directory snapshots from orders: a user is listed in each month with an order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    boss = F.col("c_custkey") - F.col("c_custkey") % 10
    people = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            "c_custkey",
            F.col("c_name").alias("employee_name"),
            F.concat(F.lit(" "), F.lower("c_name"), F.lit("@Corp.Example ")).alias("email"),
            F.col("c_mktsegment").alias("role"),
            F.col("r_name").alias("business_unit"),
            F.concat(F.lit("fu-"), F.col("c_custkey") % 6).alias("functional_unit"),
            F.col("n_name").alias("department"),
            F.concat(F.lit("team-"), F.col("c_custkey") % 10).alias("team"),
            F.concat(F.lit("  CUSTOMER#"), F.lpad(boss.cast("string"), 9, "0")).alias("supervisor"),
        )
    )
    listed = orders.select(
        "o_custkey",
        times.month_start(F.col("o_orderdate")).alias("snapshot_date"),
        F.col("o_orderkey").alias("read_order"),
    )
    return listed.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("u"), F.col("o_custkey")).alias("user_key"),
        "snapshot_date",
        "employee_name", "email", "role", "business_unit", "functional_unit", "department",
        "team", "supervisor", "read_order",
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to be enriched by month: a shipped line is an event of the ordering user."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.concat(F.lit("u"), F.col("o_custkey")).alias("user_key"),
        F.col("l_shipdate").alias("timestamp"),
        times.month_start(F.col("l_shipdate")).alias("event_month"),
    )


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long, sparse history: orders per user and day, with a rate for the rolling columns."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.concat(F.lit("u"), F.col("o_custkey")).alias("user_key"),
        F.col("o_orderdate").cast("date").alias("day"),
    ).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("usb_count_1d"),
        F.avg((F.col("o_orderkey") % 2).cast("double")).alias("ah_rate_1d"),
    )


def ranges(daily: DataFrame) -> DataFrame:
    """Two label ranges for every tenth user: from day 18 of their history for 5 days, and a
    single day three days later."""
    number = F.substring("user_key", 2, 20).cast("bigint")
    first = daily.where(number % 10 == 3).groupBy("user_key").agg(F.min("day").alias("d"))
    pair = F.array(
        F.struct(F.date_add("d", 18).alias("s"), F.date_add("d", 22).alias("e")),
        F.struct(F.date_add("d", 25).alias("s"), F.date_add("d", 25).alias("e")),
    )
    return first.select("user_key", F.explode(pair).alias("r")).select(
        "user_key",
        F.lit("SCENARIO_1").alias("scenario_id"),
        F.col("r.s").alias("exfil_start"),
        F.col("r.e").alias("exfil_end"),
    )
