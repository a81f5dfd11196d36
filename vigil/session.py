"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(name: str = "vigil", cpus: str | int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    cpus = str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: By application, the temporary folder of a local session whose settings name none.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where `spark.checkpoint.dir` is unset and all executors are in this process (tests, a
    laptop) a temporary folder of this machine is chosen, one for each application; on a
    cluster the setting is required, as a local folder would be another one on each machine.
    """
    application = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _FOLDERS.get(application)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _FOLDERS[application] = tempfile.mkdtemp(prefix="vigil-")
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def split_by_rows(files: DataFrame, rows: int) -> Iterator[None]:
    """Within it, files like those of `files` are read about `rows` rows a task.

    Spark cuts its reads by bytes of files, and wide rows that are much alike shrink a lot in
    files; what is made of them in memory does not. Where there are few rows, the number of
    cores decides as ever. Files should not be longer than `rows` (`staged`).
    """
    spark = files.sparkSession
    kept = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    each = kept.groupBy("path").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = each.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    split = max(1, found["size"] * rows // found["n"]) if found["n"] else 1
    # What opening a file costs is added to its size; here sizes stand for rows alone.
    wanted = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 0}
    was = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def staged(df: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """`df` written once to the cluster's shared folder and read back.

    For tables several branches of a query use: user-days and window scores are small next
    to the events, and a lost executor costs no recomputation from the events. With `rows_a_file`
    no file holds more rows than that.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
