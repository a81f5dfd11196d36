"""Sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigil.operators.enrich import project


def write_table(
    df: DataFrame,
    path: str,
    overwrite: bool = False,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """Parquet with zstd; an existing table is left alone unless `overwrite`."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite" if overwrite else "ignore").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False) -> None:
    """Sorted inside each file, ranges of the first key per file: no total order is needed."""
    write_table(df.repartitionByRange(*keys), path, overwrite, sort_by=keys)


def write_profiles(
    df: DataFrame, domain: str, base: str, overwrite: bool = False
) -> dict[str, str]:
    """The audit and the model table of a domain.

    The lean table is read off the full one where that has all its columns, so cleaning and
    joins run once.
    """
    paths = {profile: f"{base}/{domain}_{profile}" for profile in ("full", "lean")}
    write_table(project(df, domain, "full"), paths["full"], overwrite)
    full = df.sparkSession.read.parquet(paths["full"])
    wanted = project(df, domain, "lean").columns
    source = full if set(wanted) <= set(full.columns) else df
    write_table(source.select(*wanted), paths["lean"], overwrite)
    return paths


def write_meta(df: DataFrame, path: str, overwrite: bool = True) -> dict:
    """Write `df` and, from the same pass, its row count; returns what the sidecar holds."""
    seen = Observation("rows")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite" if overwrite else "errorifexists").option(
        "compression", "zstd"
    ).parquet(path)
    meta = {"artifact": path.rstrip("/").split("/")[-1], "rows": seen.get["rows"], "cols": df.columns}
    _put_text(df.sparkSession, f"{path.rstrip('/')}_meta.json", json.dumps(meta, indent=2))
    return meta


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document, through Spark so that any file system works."""
    one = spark.createDataFrame([(text,)], "value string").coalesce(1)
    one.write.mode("overwrite").text(path, lineSep="\n")


def write_alerts(alerts: DataFrame, path: str, overwrite: bool = True) -> None:
    """JSON lines, a folder per day.

    Ranges over day and user give each day few files and cut a day with very many alerts.
    """
    out = alerts.withColumn("alert_day", F.col("day")).repartitionByRange("alert_day", "user_key")
    out.write.mode("overwrite" if overwrite else "append").partitionBy("alert_day").json(path)
