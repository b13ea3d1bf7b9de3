"""Importing legacy exports as a stream, each block once whatever fails between.

The stream's checkpoint gives a batch its files again under the same number. A batch's new blocks are those
whose hash no other batch of the ledger has; they overwrite the ledger's part of that number, so a repeated
batch finds the same rows. What is done with them is then repeatable too: notes take a section only if they
don't have it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import vault as notes_vault
from ..sources import writers

FILES = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "path string, pos int, date string, time string, mood string, tags array<string>, text string, hash string, status string, batch long"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All blocks that batches have seen, with their status ('new' ones were imported) and batch."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{ledger}/blocks")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def into_notes(vault: str) -> Callable[[DataFrame, int], None]:
    """Appends new blocks to the notes of a vault, which are local files, in order of file and place."""

    def deliver(blocks: DataFrame, _: int) -> None:
        for r in blocks.orderBy("path", "pos").toLocalIterator():
            writers.append_once(vault, r.date, r.time, writers.with_tags(r.text, r.tags), r.mood)

    return deliver


def import_stream(spark: SparkSession, source: str, ledger: str, checkpoint: str, deliver: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Import the exports (*.md, at any depth) that come into a folder. deliver(new blocks, batch) may be called
    again for a batch that failed, with the same rows. The default trigger takes what is there and ends."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(source).select("path", "content")

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        blocks = notes_vault.legacy_blocks(rows).where("not bad")
        others = read_ledger(own, ledger).where((F.col("batch") != number) & (F.col("status") == "new"))
        marked = notes_vault.import_status(blocks, others).select(*(c.split()[0] for c in LEDGER.split(", ")[:-1]))
        marked.write.mode("overwrite").parquet(f"{ledger}/blocks/batch={number}")
        if deliver:
            deliver(read_ledger(own, ledger).where((F.col("batch") == number) & (F.col("status") == "new")).drop("status", "batch"), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
