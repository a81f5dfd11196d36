"""A catalogue of the header lines of CSV files, made without reading the files.

Releases differ in their columns, so each file's header has to be known before its rows can be
read. Tasks open the listed files and read on until the first line ends: one block of a file
as a rule, whatever the file's size. (A limit inside Spark's own scan does not do this: it is one
limit for all files, and a Python function that stops early still has the whole file sent to it.)
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 14
#: Files that one task opens, on average.
FILES_A_TASK = 64
_HEADS = pa.schema([("file", pa.string()), ("opened", pa.bool_()), ("head", pa.string())])


def first_line(uri: str) -> str | None:
    """The first line of a file, decompressed as its name says; None if it is empty."""
    store, path = fs.FileSystem.from_uri(uri)
    held = b""
    with store.open_input_stream(path, compression="detect", buffer_size=None) as stream:
        while block := stream.read(BLOCK):
            held += block
            ends = [at for at in (held.find(b"\n"), held.find(b"\r")) if at >= 0]
            if ends:
                return held[: min(ends)].decode("utf-8", "replace")
    return held.decode("utf-8", "replace") if held else None


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            try:
                row = (uri, True, first_line(uri))
            except (pa.ArrowException, OSError, ValueError):  # a store that only Spark opens
                row = (uri, False, None)
            yield pa.record_batch([[x] for x in row], schema=_HEADS)


def _scanned(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """{file: first line} by Spark's reader, which reads the files whole."""
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    found = lines.where("at = 0").groupBy("file").agg(F.first("value").alias("head"))
    return {unquote(r["file"]): r["head"] for r in found.toLocalIterator()}


def header_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, opened, head): the first line of each file at `path`, null where it is empty or could not be opened."""
    files = sorted(spark.read.text(path).inputFiles())
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, -(-len(files) // FILES_A_TASK))).mapInArrow(_heads, "file string, opened boolean, head string")


def heads(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """{path of a file: its first line, '' where it is empty}.

    One row per file comes to the driver, as Spark's own file list does. Files in a store that
    tasks cannot open by themselves are scanned by Spark.
    """
    found: dict[str, str] = {}
    closed: list[str] = []
    for row in header_lines(spark, path).toLocalIterator():
        if row["opened"]:
            found[unquote(row["file"])] = (row["head"] or "").removeprefix("\ufeff")
        else:
            closed.append(unquote(row["file"]))
    if closed:
        one_form = lambda f: f.replace("file:///", "file:/", 1)
        scanned = {one_form(f): head for f, head in _scanned(spark, closed).items()}
        found |= {f: scanned.get(one_form(f), "").removeprefix("\ufeff") for f in closed}
    return found


def layouts(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """{header line: paths of the files that begin with it}; empty files are left out."""
    groups: dict[str, list[str]] = {}
    for file, head in heads(spark, path).items():
        if head:
            groups.setdefault(head, []).append(file)
    return {head: sorted(files) for head, files in sorted(groups.items())}


def columns_of(head: str) -> list[str]:
    """The column names of a header line."""
    return [c.strip() for c in next(csv.reader([head]), [])]
