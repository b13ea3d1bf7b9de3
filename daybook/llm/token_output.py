"""Token ids as ORC: stripes with run-length encoded integers, row indexes, Bloom filters on doc_id.

Rows lie in ascending doc_id order across files and within them, so a reader can split the files by
stripe, and skip stripes and row groups by their doc_id ranges and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gather, lean, materialise, new_path, text_of
from .tokens import WordEncoder, vocabulary_path

END_ID = 1
#: A stripe is a reader's share of work; a row group of the index is what pruning skips (some megabytes of ids).
STRIPE_BYTES, INDEX_STRIDE, BLOOM_FPP = 64 << 20, 1_000, 0.01
ROW = "doc_id long, part int, pos long, ids array<int>"


def encode_rows(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order: their ids with the end id, and their place in the part."""
    encoder, pos = WordEncoder.of(vocabulary), 0
    for batch in gather(batches):
        for at, ids, offsets in encoder.encode(batch.column("text"), end_id):
            part = batch.slice(at, len(offsets) - 1)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))
            places = pa.array(np.arange(pos, pos + part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), places, lists], ["doc_id", "part", "pos", "ids"])
            pos += part.num_rows


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("pos"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "part", "pos", "n_tokens", "ids_crc32"],
        )


def write_tokens(
    spark: SparkSession, docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
    stripe_bytes: int = STRIPE_BYTES, index_stride: int = INDEX_STRIDE,
) -> str:
    """Encode the whole texts of docs (doc_id, text) and write them to path as ORC, in doc_id order.

    Null text counts as empty: its ids are the end id alone. Null ids come first. Rows that share an
    id are all written, ordered by text. Other columns are ignored; an empty table writes no rows.
    """
    vocabulary = vocabulary or vocabulary_path()
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id()).select("doc_id", "part", "text")
    (
        rows.mapInArrow(lean(lambda it: encode_rows(it, vocabulary, end_id)), ROW)
        .write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_stride)
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; predicates on doc_id are pushed to the stripes."""
    return spark.read.schema(ROW).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files at path.

    start is the ids of all rows before: those of earlier parts (a few totals) plus a running sum
    within the part.
    """
    rows = read_tokens(spark, path).mapInArrow(checksums, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    rows = materialise(spark, rows, "token-rows")  # a few numbers for each document: the ids are read once
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return rows.withColumn("run", run).join(before, "part").select("doc_id", (F.col("base") + F.col("run")).alias("start"), "n_tokens", "ids_crc32")


def token_output(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write docs as token files (in the shared folder unless a path is given) and describe them from there."""
    return token_index(spark, write_tokens(spark, docs, path or new_path(spark, "tokens"), vocabulary, end_id))
