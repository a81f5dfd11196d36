"""Registered queries that go through the files: driver tables written out, and read by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import text
from vigil.operators import directory, enrich, labels
from vigil.plans import frames
from vigil.plans.queries import query
from vigil.schemas import DIRECTORY_ATTRS
from vigil.session import scratch_path
from vigil.sources import driver_tables as tables, readers, writers


def logon_files(spark, sf):
    """Logons as raw CSV: two files whose headers differ in order, names and columns."""
    events = tables.table(spark, sf, "events").where(F.col("event_type") == "signup")
    rows = tables.event_columns(events).select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss").alias("date"),
        F.concat(F.lit("DTAA/"), F.upper("user_key")).alias("user"),
        "pc",
        F.when(F.col("event_id") % 2 == 0, "Logon").otherwise("Logoff").alias("activity"),
    )
    path = scratch_path(spark, "logon-csv")
    even = F.col("id").cast("bigint") % 2 == 0
    rows.where(even).write.option("header", True).csv(path)
    swapped = rows.where(~even).select("activity", F.col("user").alias("User"), "id", F.lit("x").alias("extra"), "date", "pc")
    swapped.write.mode("append").option("header", True).csv(path)
    return path


def _clean_logons(spark, sf):
    return enrich.clean_events(readers.read_events(spark, logon_files(spark, sf), "logon"), "logon")


@query
def csv_events_roundtrip(spark, sf):
    """Clean logons out of raw files, by user and what the row tells."""
    return _clean_logons(spark, sf).groupBy("user_key", "activity", "after_hours").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pc").alias("machines")
    )


def _in_two_layouts(rows, split, first, second, path, folder=None):
    """`rows` as CSV files with two headers; with `folder`, one folder for each of its values."""
    for part, columns, mode in ((rows.where(split), first, "error"), (rows.where(~split), second, "append")):
        part = part.select(*columns) if folder is None else part.select(*columns, folder).repartition(folder)
        out = part.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        (out if folder is None else out.partitionBy(folder)).csv(path)
    return path


@query
def directory_csv_roundtrip(spark, sf):
    """Monthly snapshots out of raw files whose headers differ: the last row of a user in a month."""
    rows = tables.directory_rows(spark, sf).withColumns({
        "user_id": F.concat(F.lit("DTAA/"), F.upper("user_key")),
        "extra": F.lit("x,\"y\""),
        "month": F.date_format("snapshot_date", "yyyy-MM"),
    })
    attrs = [*DIRECTORY_ATTRS]
    swapped = ["extra", *reversed(attrs), F.col("user_id").alias("USER_ID")]
    path = _in_two_layouts(rows, F.col("read_order") % 2 == 0, ["user_id", *attrs], swapped, scratch_path(spark, "directory-csv"), "month")
    return directory.snapshots(readers.read_directory(spark, path)).select("user_key", "snapshot_date", *DIRECTORY_ATTRS, "email_domain")


@query
def insiders_roundtrip(spark, sf):
    """The insiders of one data set out of a list that holds several."""
    stamp = lambda c: F.date_format(c, "MM/dd/yyyy HH:mm:ss")
    own = frames.ranges(spark, sf).select(
        F.explode(F.array(F.lit("5.2"), F.lit(" 5.2 "), F.lit("4.2"))).alias("dataset"), F.lit("1").alias("scenario"),
        F.lit("r5.2-1.csv").alias("details"), F.concat(F.lit("DTAA\\"), F.upper("user_key")).alias("user"),
        stamp("exfil_start").alias("start"), stamp("exfil_end").alias("end"),
    )
    first = ["dataset", "scenario", "details", "user", "start", "end"]
    path = _in_two_layouts(own, F.col("dataset") == "5.2", first, ["user", "end", "start", "scenario", "dataset"], scratch_path(spark, "insiders-csv"))
    return readers.read_insiders(spark, path)


@query
def truth_file_scan(spark, sf):
    """Ranges of malicious days out of ragged answer files, a folder for each insider; broken lines are left out."""
    days = tables.event_columns(tables.table(spark, sf, "events")).join(frames.ranges(spark, sf), "user_key")
    days = days.where(F.col("timestamp").cast("date").between(F.col("exfil_start"), F.col("exfil_end")))
    time = F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss")
    line = F.concat_ws(",", "domain", "event_id", time, F.upper("user_key"), "pc", F.lit("a, b"))
    broken = F.when(F.col("event_id") % 5 == 0, F.concat_ws(",", "domain", "event_id", F.lit("n/a"), "pc")).when(F.col("event_id") % 7 == 0, "short").otherwise(line)
    path = scratch_path(spark, "answers")
    days.select(broken.alias("value"), F.concat(F.lit("r5.2-1-"), F.upper("user_key")).alias("case")).repartition("case").write.partitionBy("case").text(path)
    truth = readers.read_ground_truth(spark, path, by_folder=True)
    return labels.exfil_ranges(truth).join(truth.groupBy("user_key").agg(F.count(F.lit(1)).alias("n_lines")), "user_key").select(
        "user_key", "exfil_start", "exfil_end", "n_lines"
    )


@query
def profiles_roundtrip(spark, sf):
    """The model profile of the logons, written and read."""
    paths = writers.write_profiles(_clean_logons(spark, sf), "logon", scratch_path(spark, "profiles"))
    lean = spark.read.parquet(paths["lean"])
    return lean.groupBy("user_key", F.col("timestamp").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def alerts_json_roundtrip(spark, sf):
    """Alert lines written as JSON and read back."""
    path = scratch_path(spark, "alert-lines")
    writers.write_alerts(frames.raw_alerts(spark, sf), path)
    return readers.read_alerts(spark, path).select(
        "user_key", "day", "detector", "reason", "score", "rules_score", "anomaly_score", "ml_score", "forecast_score"
    )


@query
def daily_scan(spark, sf):
    """User-days of a span of days, the span and the columns left to the scan."""
    path = scratch_path(spark, "daily")
    writers.write_sorted(frames.daily_user(spark, sf).select("user_key", "day", "logon_n_logon", "http_n_http"), path, ["user_key", "day"])
    return readers.read_daily(spark, path, "2024-01-08", "2024-01-14", ["user_key", "day", "http_n_http"])


@query
def truth_flags(spark, sf):
    """Flags of removable media as the raw files spell them."""
    part = tables.table(spark, sf, "part")
    spelled = F.element_at(F.array(*[F.lit(x) for x in (" TRUE ", "t", "Yes", "1", "false", "No", "0", "?")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return part.select("p_partkey", text.to_bool(spelled).alias("flag"))
