"""Checks that return rows (check, table, column, bad, total); each table is read once."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FINDING = "check string, table string, column string, bad bigint, total bigint"

# Columns a daily table must have.
REQUIRED = {
    "logon_daily": ("user_key", "day", "n_logon", "after_hours_rate", "is_active_employee_day"),
    "device_daily": ("user_key", "day", "n_device_events", "after_hours_rate", "is_active_employee_day"),
    "file_daily": ("user_key", "day", "n_file_events", "after_hours_rate", "is_active_employee_day"),
    "http_daily": ("user_key", "day", "n_http", "after_hours_rate", "is_active_employee_day"),
    "email_daily": ("user_key", "day", "n_email_sent", "after_hours_rate", "is_active_employee_day",
                    "n_internal_only", "n_internal_to_external", "n_external_to_internal", "n_external_only"),
}
PREFIX_REQUIRED = ("after_hours_rate", "is_active_employee_day")


def _matching(columns: Sequence[str], pattern: str) -> list[str]:
    return [c for c in columns if fnmatch.fnmatch(c, pattern)]


def check_columns(spark: SparkSession, df: DataFrame, table: str, required: Sequence[str]) -> DataFrame:
    """One row per required column; a schema comparison, no data is read."""
    rows = [("required_column", table, c, int(c not in df.columns), 1) for c in required]
    return spark.createDataFrame(rows, FINDING)


def check_prefixes(
    spark: SparkSession, df: DataFrame, table: str, domains: Sequence[str], suffixes: Sequence[str] = PREFIX_REQUIRED
) -> DataFrame:
    return check_columns(spark, df, table, [f"{d}_{s}" for d in domains for s in suffixes])


def _rules(columns: Sequence[str], keys: Sequence[str], prefix: str = "") -> list[tuple[str, str, Column]]:
    """(check, column, condition of a bad row) for everything a single pass can see.

    With a `prefix`, a column is found under its name with the prefix before it; keys have none.
    """
    out = []
    at = lambda c: F.col(prefix + c)
    for k in keys:
        blank = F.col(k).isNull() | (F.col(k).cast("string") == "")
        out.append(("null_key", k, blank))
    for c in sorted({*_matching(columns, "n_*"), *_matching(columns, "*_n_*")}):
        out.append(("nonnegative", c, at(c) < 0))
    for c in _matching(columns, "*_rate"):
        out.append(("rate_bounds", c, (at(c) < 0) | (at(c) > 1)))
        out.append(("rate_null", c, at(c).isNull()))
    for c in sorted({*_matching(columns, "is_active_employee_day"), *_matching(columns, "*_is_active_employee_day")}):
        out.append(("flag_01", c, ~at(c).isin(0, 1)))
    return out


def check_values(df: DataFrame, table: str, keys: Sequence[str] = ("user_key", "day")) -> DataFrame:
    """Duplicate and blank keys, counts below zero, rates out of bounds or NULL, odd flags.

    Rows are first reduced per key, which also tells duplicates, then summed: one pass.
    """
    rules = _rules(df.columns, keys)
    bad = [F.count_if(F.coalesce(cond, F.lit(False))).alias(f"b{i}") for i, (_, _, cond) in enumerate(rules)]
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *bad)
    sums = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dups"),
        *[F.coalesce(F.sum(f"b{i}"), F.lit(0)).alias(f"b{i}") for i in range(len(rules))],
    )

    def finding(check: str, column: str, value: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(table).alias("table"), F.lit(column).alias("column"),
            value.alias("bad"), F.col("total"),
        )

    rows = [finding("unique_key", "+".join(keys), F.col("dups"))]
    rows += [finding(check, column, F.col(f"b{i}")) for i, (check, column, _) in enumerate(rules)]
    return sums.select(F.inline(F.array(*rows)))


def write_checked(
    df: DataFrame, path: str, table: str, parts: Mapping[str, tuple[str, Column]] | None = None,
    keys: Sequence[str] = ("user_key", "day"),
) -> DataFrame:
    """Writes `df` and returns its findings, collected while it is written.

    `parts` are narrower tables that `df` holds side by side: by name, the prefix of their columns
    and which rows have one. Values are checked by an `Observation` on the write, for all tables
    at once, so `df` is computed and read once; only repeated keys are told afterwards, from the
    key columns of what was written.
    """
    tables = {table: ("", F.lit(True)), **(parts or {})}
    named: list[tuple[str, str, str]] = []
    seen = Observation(f"checks of {table}")
    metrics: list[Column] = []
    for t, (name, (prefix, there)) in enumerate(tables.items()):
        columns = [c[len(prefix):] for c in df.columns if c.startswith(prefix) and c not in keys]
        metrics.append(F.count_if(there).alias(f"total{t}"))
        for check, column, bad in _rules(columns, keys, prefix):
            metrics.append(F.count_if(there & F.coalesce(bad, F.lit(False))).alias(f"m{len(named)}"))
            named.append((check, name, column))
    df.observe(seen, *metrics).write.option("compression", "zstd").parquet(path)
    got = seen.get
    total = {name: got[f"total{t}"] for t, name in enumerate(tables)}
    per_key = df.sparkSession.read.schema(df.schema).parquet(path).groupBy(*keys).agg(
        *[F.count_if(there).alias(f"k{t}") for t, (_, there) in enumerate(tables.values())]
    )
    again = per_key.agg(*[F.sum(F.greatest(F.col(f"k{t}") - 1, F.lit(0))).alias(f"k{t}") for t in range(len(tables))]).first()
    rows = [("unique_key", name, "+".join(keys), again[f"k{t}"] or 0, total[name]) for t, name in enumerate(tables)]
    rows += [(check, name, column, got[f"m{i}"], total[name]) for i, (check, name, column) in enumerate(named)]
    return df.sparkSession.createDataFrame(rows, FINDING)


def check_min_rows(df: DataFrame, table: str, n: int = 1000) -> DataFrame:
    """Bad when a lookup has fewer than `n` rows."""
    counted = df.agg(F.count(F.lit(1)).alias("total"))
    return counted.select(
        F.lit("min_rows").alias("check"), F.lit(table).alias("table"), F.lit("*").alias("column"),
        (F.col("total") < n).cast("bigint").alias("bad"), "total",
    )


def profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("user_key").alias("users"),
        F.min("day").alias("min_day"),
        F.max("day").alias("max_day"),
    )


def quality_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All value checks of all tables."""
    out = None
    for name, df in tables.items():
        checked = check_values(df, name)
        out = checked if out is None else out.unionByName(checked)
    return out


def dataset_diff(base: DataFrame, trial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(check, base, trial, equal): row counts, columns, types and a signature of the keys.

    The signature is a sum of hashes of distinct keys, so the order of rows is of no account.
    """
    def measured(df: DataFrame) -> DataFrame:
        cols = [c for c in keys if c in df.columns]
        counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in cols])), 1, 8), 16, 10)
        return counted.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("rows"),
            F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("key_signature"),
        )

    shared = sorted(set(base.columns) & set(trial.columns))

    def types(df: DataFrame) -> str:
        known = dict(df.dtypes)
        return ",".join(f"{c}:{known[c]}" for c in shared)

    def facts(df: DataFrame) -> list[Column]:
        return [
            F.struct(F.lit("rows").alias("check"), F.col("rows").alias("value")),
            F.struct(F.lit("columns").alias("check"), F.lit(",".join(sorted(df.columns))).alias("value")),
            F.struct(F.lit("types").alias("check"), F.lit(types(df)).alias("value")),
            F.struct(F.lit("key_signature").alias("check"), F.col("key_signature").alias("value")),
        ]

    a = measured(base).select(F.inline(F.array(*facts(base)))).withColumnRenamed("value", "base")
    b = measured(trial).select(F.inline(F.array(*facts(trial)))).withColumnRenamed("value", "trial")
    return a.join(b, "check").withColumn("equal", F.col("base") == F.col("trial"))
