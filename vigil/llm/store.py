"""Tables kept in the cluster's shared folder between the jobs of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Cuts the lineage (a lost executor costs no recomputation from the texts) and gives the
    planner true sizes, so a join with the result broadcasts it only below Spark's limit.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
