"""Event streams: files arriving in a folder, cleaned, deduplicated, enriched."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vigil.operators import enrich
from vigil.schemas import raw_events_schema
from vigil.sources import catalogue, readers

WATERMARK = "2 days"


def with_event_time(df: DataFrame, column: str = "timestamp", delay: str = WATERMARK) -> DataFrame:
    """`ts` with a watermark. Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn("ts", F.col(column).cast("timestamp")).withWatermark("ts", delay)


#: The time of the row that ends an input: later than any event, so every window before it closes.
END = dt.datetime(9999, 1, 1)


def end_row(spark: SparkSession, schema: T.StructType, time: str = "ts") -> DataFrame:
    """The one row that ends an input: all NULL but for its time."""
    kind = schema[time].dataType
    return spark.range(1).select(*[
        (F.lit(END) if f.name == time else F.lit(None)).cast(kind if f.name == time else f.dataType).alias(f.name)
        for f in schema.fields
    ])


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """`stream` and a control source beside it, before any watermark.

    Nothing comes from the control source until `end_row` is written to its `folder`. That row moves
    the watermark past all days, so windows still open come out; it belongs to no user, and no
    window of its own ever closes. A stream that goes on must not be ended: what comes after is late.
    """
    control = stream.sparkSession.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(control)


def dedupe_stream(df: DataFrame, key: str = "id", tuple_columns: Sequence[str] = ()) -> DataFrame:
    """One row per id within the watermark; state older than that is dropped.

    A row without id is recognised by its `tuple_columns`, as in batch; without any, by all its
    columns.
    """
    names = [c for c in (tuple_columns or df.columns) if c in df.columns and c != key]
    whole = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    known = F.col(key).cast("string")
    keyed = df.withColumn("__key", F.when(known.isNotNull(), F.concat(F.lit("id:"), known)).otherwise(whole))
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def stream_events(
    spark: SparkSession,
    path: str,
    domain: str,
    internal: Sequence[str] = (),
    personal: Sequence[str] = (),
    job_sites: Sequence[str] = (),
    delay: str = WATERMARK,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Clean events of one domain from CSV files as they are dropped into `path`.

    `columns` names the files' layout where a release has other columns than the domain's
    usual ones; a file whose header differs fails the stream instead of shifting columns.
    """
    raw = (
        spark.readStream.schema(raw_events_schema(domain, columns))
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .csv(path)
    )
    clean = enrich.clean_events(raw, domain, internal, personal, job_sites, dedupe=False)
    timed = with_event_time(clean, delay=delay)
    return dedupe_stream(timed, tuple_columns=enrich.EVENT_TUPLES[domain]).withColumn("domain", F.lit(domain))


#: Columns without which a file holds no events; the user of a mail is told by its sender.
NEEDED = {"email": ("date", "from")}
_LISTED = "path string, modificationTime timestamp, length long, content binary"


def ingest_files(
    spark: SparkSession, path: str, domain: str, out: str, checkpoint: str, once: bool = False,
    files_a_batch: int = 1000, **cleaning,
) -> StreamingQuery:
    """Clean events from CSV files of any layout as they are dropped into `path`.

    A batch is a list of files: each is read by its own header, whichever releases come
    together, and cleaned as in batch. A file that lacks a needed column, or a header, is listed
    in `out`/quarantine with what its first line was, and the stream goes on; files of no bytes are passed over. Events go to
    `out`/events, both in a folder per batch that a batch tried again overwrites. Files are listed
    without being read; `read_ingested` gives the events, copies across batches removed.
    """
    needed = NEEDED.get(domain, ("date", "user"))
    listed = spark.readStream.format("binaryFile").schema(_LISTED).option("maxFilesPerTrigger", files_a_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        files = [r["path"] for r in batch.select("path").toLocalIterator()]
        if not files:
            return
        good, bad = [], []
        for file, head in catalogue.heads(session, files).items():
            missing = sorted(set(needed) - {c.lower() for c in catalogue.columns_of(head)})
            if missing:
                bad.append((file, head, f"needs {', '.join(missing)}" if head else "empty"))
            else:
                good.append(file)
        session.createDataFrame(bad, "file string, head string, reason string").coalesce(1).write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        if good:
            clean = enrich.clean_events(readers.read_events(session, good, domain), domain, **cleaning)
            clean.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")

    job = listed.load(path).select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (job.trigger(availableNow=True) if once else job).start()


def read_ingested(spark: SparkSession, out: str, domain: str) -> DataFrame:
    """All events that `ingest_files` has written; an event in two batches counts once."""
    rows = spark.read.parquet(f"{out}/events").drop("batch")
    return enrich.dedupe_events(rows, "id", [c for c in enrich.EVENT_TUPLES[domain] if c in rows.columns])


def read_quarantine(spark: SparkSession, out: str) -> DataFrame:
    """(file, head, reason, batch) of the files that did not fit."""
    return spark.read.schema("file string, head string, reason string, batch long").parquet(f"{out}/quarantine")


def stream_enrich(events: DataFrame, directory: DataFrame, bounds: DataFrame) -> DataFrame:
    """Stream against static directory; the static side is read anew in every batch."""
    return enrich.flag_active(enrich.join_bounds(enrich.join_directory(events, directory), bounds))
