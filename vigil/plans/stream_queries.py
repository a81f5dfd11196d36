"""Registered queries that run as streams over what is available and return the sink's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import reports, rules, watch
from vigil.plans import frames, source_queries
from vigil.plans.queries import query
from vigil.session import scratch_path
from vigil.sources import driver_tables as tables
from vigil.streaming import ingest, sinks, stateful, windows

BATCHES = 3


def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    spark = stream.sparkSession
    folder = scratch_path(spark, label)
    job = sinks.to_table(stream, f"{folder}/rows", f"{folder}/checkpoint", once=True)
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = tables.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream that ends, so all its days and weeks close."""
    events, control = _table_stream(spark, sf, "events"), scratch_path(spark, "end-of-events")
    ingest.end_row(spark, events.schema).write.parquet(control)
    activity = tables.with_flags(tables.event_columns(ingest.with_end(events, control)))
    return ingest.dedupe_stream(ingest.with_event_time(activity), "event_id")


@query
def stream_daily(spark, sf):
    """User-days of the event stream."""
    stateful.use_state_store(spark)
    return _drain(windows.stream_daily(_events(spark, sf)), "stream-daily").drop("ts")


@query
def stream_csv_events(spark, sf):
    """Logons streamed from raw files of two layouts, with a third kind that does not fit and is set aside."""
    path, out = source_queries.logon_files(spark, sf), scratch_path(spark, "ingested")
    strays = tables.event_columns(tables.table(spark, sf, "events")).select("pc", "user_key").limit(20)
    strays.coalesce(1).write.mode("append").option("header", True).csv(path)
    job = ingest.ingest_files(spark, path, "logon", out, f"{out}/checkpoint", once=True, files_a_batch=5)
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()
    events = ingest.read_ingested(spark, out, "logon").groupBy("user_key", "activity", "after_hours").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pc").alias("machines")
    )
    aside = ingest.read_quarantine(spark, out).agg(F.countDistinct("reason").alias("reasons")).select(
        F.lit("").alias("user_key"), F.lit("set aside").alias("activity"), F.lit(False).alias("after_hours"),
        F.lit(0).cast("long").alias("n"), F.col("reasons").alias("machines"),
    )
    return events.unionByName(aside)


@query
def stream_trend(spark, sf):
    """Sliding weeks of the event stream."""
    stateful.use_state_store(spark)
    return _drain(windows.stream_trend(_events(spark, sf)), "stream-trend")


@query
def stream_enrich(spark, sf):
    """Event stream against the static directory, counted by employment."""
    people = tables.event_users(spark, sf)
    directory = people.select("user_key", F.lit("2024-01-01").cast("date").alias("event_month"), "role", "department")
    df = ingest.stream_enrich(_events(spark, sf), directory, people)
    rows = _drain(df.where(F.col("domain").isNotNull()).select("user_key", "domain", "role", "joined_ldap", "join_reason"), "stream-enrich")
    return rows.groupBy("role", "domain", "joined_ldap", "join_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_rules(spark, sf):
    """Rule alerts with each user's last rows held as state."""
    stateful.use_state_store(spark)
    measured = rules.ah_signal(frames.features(spark, sf), frames.RULES)
    days = frames.staged(stateful.rule_days(measured), "rule-days")
    source = stateful.with_day_time(_out_of_order(days, "rule-days", after=61), "60 days")
    return _drain(stateful.stream_rules(source, frames.RULES, groups=stateful.groups_for(days)), "stream-rules")


@query
def stream_watch(spark, sf):
    """Watch windows of an alert stream, the last ones too."""
    stateful.use_state_store(spark)
    days = frames.staged(watch.watch_days(frames.canonical(spark, sf, watch.WATCHED)), "watch-days")
    source = stateful.with_day_time(_out_of_order(days, "watch-days", after=70), "60 days")
    return _drain(stateful.stream_watch(source, groups=stateful.groups_for(days)), "stream-watch")


@query
def stream_rollups(spark, sf):
    """The user ranking over all batches of an alert stream."""
    alerts = frames.canonical(spark, sf, reports.ROLLED_UP)
    folder = scratch_path(spark, "stream-rollups")
    source = _out_of_order(alerts, "rollup-alerts")
    sinks.stream_rollups(source, folder, f"{folder}/checkpoint", once=True).awaitTermination()
    totals = spark.read.option("basePath", f"{folder}/users").parquet(f"{folder}/users")
    return sinks.merge_rankings(totals)


def _out_of_order(kept: DataFrame, label: str, after: int | None = None) -> DataFrame:
    """The staged `kept` as a stream of three batches in no order of days, and an end-of-input row at last.

    Rows are dealt by their hash where they are, so a batch is written by all tasks and has as many files.
    """
    spark, folder = kept.sparkSession, scratch_path(kept.sparkSession, label)
    dealt = F.pmod(F.xxhash64(*kept.columns), F.lit(BATCHES))
    for batch in range(BATCHES):
        kept.where(dealt == batch).write.mode("append").parquet(folder)
    files = len(spark.read.schema(kept.schema).parquet(folder).inputFiles())
    if after is not None:
        stateful.end_of_input(kept, after).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES)))
    return stream.parquet(folder)
