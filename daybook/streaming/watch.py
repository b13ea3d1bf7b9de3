"""Watching a vault: a timed stream whose batches are snapshot diffs.

Spark's file source sees new paths only, neither edits nor deletions, so each trigger compares the
listing with the stored files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.vault import scan, snapshot_diff

LEAST_SECONDS, DEFAULT_SECONDS = 1, 30


def watch(spark: SparkSession, vault: str, files: str, on_change, checkpoint: str, seconds: float = DEFAULT_SECONDS) -> StreamingQuery:
    """Call on_change(diff, batch) whenever files changed since the table at path files was written."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def batch(_, number: int) -> None:
        diff = snapshot_diff(spark.read.parquet(files), scan(spark, vault)).where(F.col("change") != "same")
        if diff.limit(1).count():
            on_change(diff, number)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(LEAST_SECONDS, seconds)} seconds").start()

