"""Sinks of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators import reports


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False, fmt: str = "parquet") -> StreamingQuery:
    """Append to a folder, exactly once by the sink's log and the checkpoint."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def stream_alerts(alerts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Alert lines as JSON."""
    return to_table(alerts, path, checkpoint, once, "json")


def stream_rollups(alerts: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Per batch the day counts of its alerts and the rows they are ranked by, in a folder per batch.

    A batch that is tried again overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Kept rows are held as they are in memory, and texts are most of an alert.
        batch = batch.select(*reports.ROLLED_UP).persist()
        try:
            beat = batch.groupBy("day").agg(*reports.pulse())
            beat.write.mode("overwrite").parquet(f"{folder}/heartbeat/batch={batch_id}")
            users = reports.user_totals(batch)
            users.write.mode("overwrite").parquet(f"{folder}/users/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def merge_rankings(totals: DataFrame) -> DataFrame:
    """The ranking over all batches from the batches' user totals."""
    kept = totals.drop("batch") if "batch" in totals.columns else totals
    return reports.ranked_users(reports.merged_totals(kept))


def merge_heartbeats(batches: DataFrame) -> DataFrame:
    """One row per day from the batches' heartbeats."""
    names = ["count", "escalated_count", "rule_count", "ml_count", "anomaly_count"]
    return batches.groupBy("day").agg(*[F.sum(n).alias(n) for n in names])
