"""Scans of the raw logs, the directory, ground truth and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import text, times
from vigil.schemas import ALERT, DIRECTORY_ATTRS, RAW_EVENTS, RAW_INSIDERS, raw_events_schema
from vigil.sources import catalogue


def _layouts(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(columns, files) of the CSV files at `path`, by their header lines."""
    return [(catalogue.columns_of(head), files) for head, files in catalogue.layouts(spark, path).items()]


def _by_header(spark: SparkSession, path: str, wanted: Sequence[str], needed: Sequence[str] = ()) -> DataFrame:
    """CSV with headers as strings, columns by name whatever their order, NULL where absent.

    A file that lacks a `needed` column is refused, not only a first one.
    """
    out = None
    for columns, files in _layouts(spark, path):
        named = {c.lower() for c in columns}
        missing = [c for c in needed if c not in named]
        if missing:
            raise ValueError(f"{files[0]} needs the columns {missing}")
        spelled = {w.lower(): w for w in wanted}
        schema = T.StructType([T.StructField(spelled.get(c.lower(), c), T.StringType()) for c in columns])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"')
        rows = reader.csv(files)
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
            F.monotonically_increasing_id().alias("line"),
        )
        rows = rows.select("*", file_stem().alias("__stem"), folder_name().alias("__folder"), place.alias("__place"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        kinds = T.StructType([T.StructField(w, T.StringType()) for w in wanted])
        out = spark.createDataFrame([], kinds).select(
            "*", F.lit("").alias("__stem"), F.lit("").alias("__folder"),
            F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("line")).alias("__place"),
        )
    absent = {w.lower() for w in wanted} - {c.lower() for c in out.columns}
    return out.select("*", *[F.lit(None).cast("string").alias(w) for w in wanted if w.lower() in absent])


def file_stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def folder_name() -> Column:
    """The name of the folder a file lies in; of a partition folder `key=value` only the value.

    It is told for every row, so by cutting the path, not by a pattern tried at each of its places.
    """
    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    return F.substring_index(folder, "=", -1)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """All monthly snapshots in a folder; the month comes from the file name `YYYY-MM.csv`.

    A snapshot too large for one file may be a folder `YYYY-MM` (or `month=YYYY-MM`) of files. Each file's own header says which column is where; one without `user_id` is refused.
    """
    df = _by_header(spark, path, ("user_id", *DIRECTORY_ATTRS), needed=("user_id",))
    named = lambda c: F.nullif(F.regexp_extract(F.right(c, F.lit(7)), r"^(\d{4}-\d{2})$", 1), F.lit(""))
    month = F.to_date(F.concat(F.coalesce(named("__stem"), named("__folder")), F.lit("-01")))
    return df.select(
        text.normalize_user(F.col("user_id")).alias("user_key"),
        month.alias("snapshot_date"),
        *DIRECTORY_ATTRS,
        F.col("__place").alias("read_order"),
    )


def read_events(spark: SparkSession, path: str, domain: str, by_name: bool = True) -> DataFrame:
    """Raw events of a domain, all strings. Large files are split by Spark, not by us.

    With `by_name` the header decides which columns exist (releases differ); without it the
    fixed layout of the domain is taken and nothing is read ahead.
    """
    if by_name:
        return _by_header(spark, path, RAW_EVENTS[domain]).drop("__stem", "__folder", "__place")
    reader = spark.read.schema(raw_events_schema(domain)).option("header", True)
    reader = reader.option("mode", "PERMISSIVE").option("enforceSchema", False)
    return reader.option("escape", '"').csv(path)


def read_daily(
    spark: SparkSession, path: str, start=None, end=None, columns: Sequence[str] | None = None
) -> DataFrame:
    """User-days in [start, end]; both the range and the columns reach the parquet scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("day") <= F.lit(end).cast("date"))
    return df.select(*columns) if columns else df


def read_ground_truth(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """(user_key, ts) of ragged answer lines: the third field is the time, the user is the
    last part of the file name, or with `by_folder` of the folder's name. Lines that do not
    parse are left out."""
    lines = spark.read.text(path).select(
        F.lower(F.substring_index(folder_name() if by_folder else file_stem(), "-", -1)).alias("user_key"),
        F.try_element_at(F.split("value", ",", 4), F.lit(3)).alias("field"),
    )
    parsed = lines.select("user_key", times.parse_ts(F.col("field")).alias("ts"))
    return parsed.where(F.col("ts").isNotNull())


def read_insiders(spark: SparkSession, path: str, dataset: str = "5.2") -> DataFrame:
    df = _by_header(spark, path, RAW_INSIDERS)
    mine = df.where(F.trim(F.col("dataset")) == dataset)
    return mine.select(
        text.normalize_user(F.col("user")).alias("user_key"),
        F.col("scenario").cast("string").alias("scenario"),
        times.parse_ts(F.col("start")).cast("date").alias("start"),
        times.parse_ts(F.col("end")).cast("date").alias("end"),
    ).distinct()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert lines; malformed ones and heartbeats are left out."""
    df = spark.read.schema(ALERT).option("mode", "DROPMALFORMED").json(path)
    return df.where(F.coalesce(F.col("detector"), F.lit("")) != "loop")
