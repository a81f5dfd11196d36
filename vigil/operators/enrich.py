"""Cleaning raw events and attaching directory context, flags and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import text, times, web
from vigil.schemas import PROFILES, RAW_EVENTS

# What identifies an event of a domain that carries no id.
EVENT_TUPLES = {
    "logon": ("timestamp", "user_key", "pc", "activity"),
    "device": ("timestamp", "user_key", "pc", "activity"),
    "file": ("timestamp", "user_key", "pc", "filename", "activity"),
    "http": ("timestamp", "user_key", "pc", "url"),
    "email": ("timestamp", "user_key", "from_key", "to", "cc", "bcc"),
}


# --- dedupe and filters -------------------------------------------------------------------


def dedupe_events(df: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """One row per id; a row without an id is identified by `keys` instead.

    The test is made row by row, so rows without ids spread over their own keys and do not
    meet in one NULL group. Copies are dropped before the shuffle (partial aggregation).
    """
    tag = "__tuple_key"
    no_id = F.col(id_col).isNull()
    marked = df.withColumn(tag, F.when(no_id, F.struct(*[F.col(k) for k in keys])))
    return marked.dropDuplicates([id_col, tag]).drop(tag)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under `order`.

    `row_number() <= 1` is cut to one row per key in every map task before the shuffle, so
    a key with very many rows is no burden for one task.
    """
    rank = "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= 1).drop(rank)


def expect_none(df: DataFrame, predicate: Column, message: str) -> DataFrame:
    """Pass `df` through; the job fails with `message` on the first row that meets `predicate`."""
    bad = F.coalesce(predicate, F.lit(False))
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key that fail the job on the first repeated key; one row per key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return expect_none(counted, F.col("n") > 1, f"repeated key ({', '.join(keys)})")


def day_slice(df: DataFrame, start, end, column: str = "day") -> DataFrame:
    """Half-open slice [start, end)."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def as_of(df: DataFrame, day, column: str = "day") -> DataFrame:
    """Only what was visible on `day`; NULL shows all."""
    return df if day is None else df.where(F.col(column) <= F.lit(day).cast("date"))


def exclude_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select("user_key"), "user_key", "left_anti")


def exclude_admins(events: DataFrame, directory: DataFrame) -> DataFrame:
    """Drop the events of everyone who ever held an admin role."""
    admins = directory.where(text.is_admin(F.col("role"))).select("user_key").distinct()
    return exclude_users(events, admins)


def min_history(df: DataFrame, n: int, order: str = "day") -> DataFrame:
    """Rows that are at least the `n`-th of their user."""
    window = Window.partitionBy("user_key").orderBy(order)
    counted = df.withColumn("__rn", F.row_number().over(window))
    return counted.where(F.col("__rn") >= n).drop("__rn")


# --- cleaning ----------------------------------------------------------------------------


def clean_events(
    raw: DataFrame,
    domain: str,
    internal: Sequence[str] = (),
    personal: Sequence[str] = (),
    job_sites: Sequence[str] = (),
    dedupe: bool = True,
) -> DataFrame:
    """Parsed, normalised and deduplicated events of one domain with all row-level flags."""
    for name in RAW_EVENTS[domain]:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    sender = F.col("from") if domain == "email" else F.lit(None).cast("string")
    user = F.coalesce(F.col("user"), text.handle_of(sender))
    df = raw.select(
        "*",
        times.parse_ts(F.col("date")).alias("timestamp"),
        text.normalize_user(user).alias("user_key"),
        F.col("user").alias("user_raw"),
    )
    df = df.withColumns(
        {
            "event_month": times.month_start(F.col("timestamp")),
            "after_hours": times.after_hours(F.col("timestamp")),
            "activity": text.norm_text(F.col("activity")),
            "pc": F.trim(F.col("pc")),
        }
    )
    if domain == "file":
        df = df.withColumns(
            {
                "filename": F.trim(F.col("filename")),
                "to_removable_media": text.to_bool(F.col("to_removable_media")),
                "from_removable_media": text.to_bool(F.col("from_removable_media")),
                "is_keylogger": text.is_keylogger(F.col("filename")),
            }
        )
    elif domain == "http":
        df = with_url_columns(df, job_sites)
    elif domain == "email":
        df = df.withColumns(
            {
                "from_key": text.norm_text(sender),
                "attachment_count": text.attachment_count(F.col("attachments")),
                "to_count": text.recipient_count(F.col("to")),
                "cc_count": text.recipient_count(F.col("cc")),
                "bcc_count": text.recipient_count(F.col("bcc")),
                "__domains": text.recipient_domains([F.col("to"), F.col("cc"), F.col("bcc")]),
            }
        )
        flags = text.direction_flags(sender, F.col("__domains"), internal, personal)
        df = df.withColumns(flags).drop("__domains")
    return dedupe_events(df, "id", EVENT_TUPLES[domain]) if dedupe else df


def with_url_columns(df: DataFrame, job_sites: Sequence[str] = (), url: str = "url") -> DataFrame:
    """URL measures and destination flags; the host is parsed once and then compared."""
    parsed = df.withColumn("__host", web.registrable(web.host(F.col(url))))
    return parsed.withColumns(
        {
            "url_length": web.url_length(F.col(url)),
            "url_depth": web.url_depth(F.col(url)),
            "is_wikileaks": web.among(F.col("__host"), web.LEAK_HOSTS),
            "is_dropbox": web.among(F.col("__host"), web.DROPBOX_HOSTS),
            "is_job_site": web.among(F.col("__host"), job_sites),
        }
    ).drop("__host")


def flag_listed_hosts(events: DataFrame, hosts: DataFrame, flag: str, url: str = "url") -> DataFrame:
    """Destination flag against a discovered host list (one `domain` column)."""
    listed = hosts.select(F.col("domain").alias("__host")).distinct().withColumn("__hit", F.lit(True))
    keyed = events.withColumn("__host", web.registrable(web.host(F.col(url))))
    joined = keyed.join(listed, "__host", "left")
    return joined.withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__host", "__hit")


# --- directory joins -----------------------------------------------------------------------


def join_directory(events: DataFrame, directory: DataFrame) -> DataFrame:
    """Attributes of the event's own month, and whether such a month exists.

    The bounds are left out here: they belong to the user, not to the month (`join_bounds`).
    No broadcast is asked for; Spark broadcasts the directory where its measured size allows,
    and otherwise AQE splits the partitions of users with very many events.
    """
    side = directory.drop("first_seen", "last_seen").withColumn("__joined", F.lit(True))
    joined = events.join(side, ["user_key", "event_month"], "left")
    return joined.withColumn("joined_ldap", F.coalesce("__joined", F.lit(False))).drop("__joined")


def join_bounds(events: DataFrame, bounds: DataFrame) -> DataFrame:
    side = bounds.select("user_key", "first_seen", "last_seen")
    return events.join(side, "user_key", "left")


def flag_shared_pc(events: DataFrame, shared_pcs: DataFrame) -> DataFrame:
    """`on_shared_pc`; the list holds at most the 120 or so machines `choose_shared` lets pass."""
    listed = shared_pcs.select("pc").withColumn("__shared", F.lit(True))
    joined = events.join(listed, "pc", "left")
    return joined.withColumn("on_shared_pc", F.coalesce("__shared", F.lit(False))).drop("__shared")


def flag_unassigned_pc(events: DataFrame, assigned_pc: DataFrame) -> DataFrame:
    """TRUE only where the user has a stable machine and this is another one."""
    side = assigned_pc.select("user_key", "assigned_pc")
    joined = events.join(side, "user_key", "left")
    other = F.col("pc") != F.col("assigned_pc")
    return joined.withColumn("on_unassigned_pc", F.coalesce(other, F.lit(False)))


def flag_active(events: DataFrame) -> DataFrame:
    month, first, last = F.col("event_month"), F.col("first_seen"), F.col("last_seen")
    return events.withColumns(
        {
            "user_is_active_employee": times.is_active(month, first, last),
            "join_reason": times.join_reason(month, first, last),
        }
    )


def enrich_events(
    events: DataFrame,
    directory: DataFrame,
    bounds: DataFrame,
    shared_pcs: DataFrame | None = None,
    assigned_pc: DataFrame | None = None,
) -> DataFrame:
    """The whole chain from clean events to the columns of the full profile.

    What belongs to the user (bounds and own machine) is one table, so events are joined once
    by month and once by user. Two joins in a row on the user would keep AQE from splitting
    a user with very many events.
    """
    users = bounds.select("user_key", "first_seen", "last_seen")
    if assigned_pc is not None:
        users = users.join(assigned_pc.select("user_key", "assigned_pc"), "user_key", "full")
    df = flag_active(join_directory(events, directory).join(users, "user_key", "left"))
    df = df.withColumn("is_admin", text.is_admin(F.col("role")))
    if assigned_pc is not None:
        df = df.withColumn("on_unassigned_pc", F.coalesce(F.col("pc") != F.col("assigned_pc"), F.lit(False)))
    return df if shared_pcs is None else flag_shared_pc(df, shared_pcs)


def project(df: DataFrame, domain: str, profile: str) -> DataFrame:
    """The columns of a profile, those the table lacks left out."""
    return df.select(*[c for c in PROFILES[domain][profile] if c in df.columns])


def recipient_edges(email: DataFrame, fields: Sequence[str] = ("to", "cc", "bcc")) -> DataFrame:
    """How many mails went from whom to whom."""
    all_of = F.flatten(F.array(*[text.recipients(F.col(c)) for c in fields]))
    pairs = email.select("from_key", F.explode(all_of).alias("to_key"))
    pairs = pairs.withColumn("to_key", text.norm_text(F.col("to_key")))
    return pairs.groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("n"))


def top_domains(texts: DataFrame, n: int = 50) -> DataFrame:
    """The `n` most frequent registrable domains among all URLs in `text`."""
    links = texts.select(F.explode(F.regexp_extract_all("text", F.lit(web.url_pattern()), F.lit(1))).alias("url"))
    found = links.select(web.registrable(web.host(F.col("url"))).alias("domain"))
    counted = found.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "domain").limit(n)
