"""Streaming twins of two batch questions: gaps between events of a user, and a running snapshot diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import compare


def sessions(events: DataFrame, gap: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions parted by a gap; state is dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark takes no time without a zone
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def diff_batches(previous: DataFrame, sink):
    """A foreachBatch function that writes each batch's difference from a snapshot."""

    def run(batch: DataFrame, number: int) -> None:
        sink(compare.snapshot_diff(previous, batch), number)

    return run
