"""Helpers shared by the corpus operators: shared storage, skew-safe joins, bounded filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..sources.storage import materialise, new_path, shared_dir  # noqa: F401

#: A key counts as hot when it holds at least 1/HOT_KEYS of the rows, so at most HOT_KEYS keys are hot.
HOT_KEYS = 1000
#: Bits of the filter that prunes rows ahead of an exact join: 16 for a key, within these bounds (16 MB at most).
FILTER_LEAST, FILTER_MOST = 1 << 16, 1 << 27
FILTER_PROBES = 4
#: Rows of a block whose bits tell which of them go, and blocks (of some 560 bytes) that are broadcast at most.
BLOCK_ROWS, BROADCAST_BLOCKS = 1 << 12, 1 << 16
#: Rows in a batch of texts for Python.
BATCH_ROWS = 1000


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_key(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the name of its column, which no other column has. It is written
    out (as small as may be, for it holds the texts), so that the key stays the same in all uses."""
    (key,) = free_names(docs, "_row")
    keyed, path = docs.withColumn(key, F.monotonically_increasing_id()), new_path(spark, "keyed")
    keyed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(keyed.schema).parquet(path), key


def lean(run):
    """A batch function that gives its worker's free memory back when the task ends: workers are reused
    by other stages, and their memory is an executor's."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def gather(batches, most: int = 12 << 20):
    """Record batches joined until they hold so many bytes."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def hold_batches(spark: SparkSession) -> None:
    """Hold the session's batches to Python to BATCH_ROWS rows, as texts may be long. This setting of the
    session stays; Spark reads it when a plan runs, so it cannot be given to one plan alone."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the needed columns, null text as empty; whatever else the table has is left behind. Holds the
    session's batches to Python to BATCH_ROWS rows."""
    hold_batches(docs.sparkSession)
    return docs.select(*columns, F.coalesce(docs["text"], F.lit("")).alias("text"))


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str, salt: str, total: int) -> DataFrame:
    """Left join on key where right has each key once, with the number of left rows that have it.

    Keys that hold 1/HOT_KEYS of all rows number at most HOT_KEYS and are broadcast. Other keys go
    through a shuffle; the rows of hot keys are dealt out by the salt column there, so that no task
    gets a hot group.
    """
    least = max(1, -(-total // HOT_KEYS))
    values = [c for c in right.columns if c != key]
    names = {c: f"_hot_{c}" for c in values}
    hot = right.where(F.col(count) >= least).select(key, *(F.col(c).alias(n) for c, n in names.items()), F.lit(True).alias("_hot"))
    cold = right.where(F.col(count) < least).withColumn("_salt", F.lit(0))
    out = left.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(9973)).cast("int") + 1).otherwise(0))
    out = out.join(cold, [key, "_salt"], "left")
    for c, n in names.items():
        out = out.withColumn(c, F.coalesce(F.col(n), F.col(c))).drop(n)
    return out.drop("_salt", "_hot")


def prune_filter(keys: DataFrame, key: str):
    """A Bloom filter over a long or string column as a boolean UDF: no key is missed, few others pass.

    Spark counts the keys and fills the filter word by word (bit_or), so what reaches the driver is
    FILTER_MOST bits at most, whatever the data's size. It only saves shuffle ahead of an exact join:
    past some 8 million keys more rows pass, and results stay the same.
    """
    wanted = 16 * max(1, keys.count())
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (wanted - 1).bit_length()))
    probes = F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(FILTER_PROBES)))
    rows = (
        keys.select(F.explode(probes).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        .toArrow()
    )
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)

    @F.pandas_udf(BooleanType())
    def passes(positions: pd.Series) -> pd.Series:
        p = np.array(positions.tolist(), dtype=np.int64).reshape(-1, FILTER_PROBES)
        hit = (table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
        return pd.Series(hit.all(axis=1))

    return passes(probes)


def without_rows(spark: SparkSession, keyed: DataFrame, gone: DataFrame, row: str, most_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """keyed, as with_row_key gives it, but for the rows whose key is in gone (a column of that name).

    No row of keyed is shuffled, at any size, and nothing is decided by chance: what goes is a bit for each row
    of a block of BLOCK_ROWS, and the blocks that have such bits are broadcast, most_blocks of them at most. If
    there are more, the table is read in ranges of its keys, a part for each broadcast, and what stays is
    written: each part reads its own files only, as keys ascend from file to file.
    """
    block, held, bits = free_names(keyed, "_block", "_held", "_bits")
    key = F.col(row)
    words = gone.groupBy(F.shiftright(key, 12).alias(block), F.shiftright(key, 6).bitwiseAND(63).cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{row}` & 63 as int)))").alias("b"))
    full = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at(F.col(held), i), F.lit(0).cast("long")))
    blocks = words.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias(held)).select(block, full.alias(bits))
    blocks = materialise(spark, blocks, "gone")

    def left(rows: DataFrame, own: DataFrame) -> DataFrame:
        asked = rows.withColumn(block, F.shiftright(key, 12)).join(F.broadcast(own), block, "left")
        goes = F.expr(f"shiftright(get(`{bits}`, cast(shiftright(`{row}`, 6) & 63 as int)), cast(`{row}` & 63 as int)) & 1")
        return asked.where(F.coalesce(goes, F.lit(0).cast("long")) == 0).drop(block, bits)

    n = blocks.count()
    if n <= most_blocks:
        return left(keyed, blocks)
    parts = -(-n // (most_blocks // 2))
    cuts = [None, *sorted({int(x) for x in blocks.approxQuantile(block, [k / parts for k in range(1, parts)], 0.1 / parts)}), None]
    path = new_path(spark, "left")
    for a, b in zip(cuts, cuts[1:], strict=False):
        within = lambda c, a=a, b=b, scale=1: (F.lit(True) if a is None else c >= a * scale) & (F.lit(True) if b is None else c < b * scale)
        left(keyed.where(within(key, scale=BLOCK_ROWS)), blocks.where(within(F.col(block)))).write.mode("append").parquet(path)
    return spark.read.schema(keyed.schema).parquet(path)


def stream_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of a partition that is sorted by keys, without an Arrow round trip for each group."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(pdf)), cuts):
            piece, at = pdf.iloc[part[0] : part[-1] + 1], tuple(values[part[0]])
            if last is not None and at != last:
                yield last, pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
            last = at
    if held:
        yield last, pd.concat(held, ignore_index=True)


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for edges (u, v) of longs; root is the least node of the connected component.

    Trees are hooked and flattened, after Zhang, Azad and Hu (FastSV, 2020): in each round a node and the
    root of its tree both take the least grandparent that a neighbour has, and every node moves up to its
    own. Chains of any length settle in a logarithmic number of rounds. Minima are partial aggregates, and
    nodes of many edges and roots of many nodes are joined as hot keys. Rounds end when nothing changes.
    """
    both = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    both = materialise(spark, both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    total = max(1, both.count())
    first = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"), F.count("*").alias("n"))
    labels = materialise(spark, first.select(F.col("u").alias("node"), "root", "n"), "labels")
    for _ in range(rounds):
        crowds = labels.groupBy("root").agg(F.count("*").alias("m"))
        above = crowds.join(labels.select(F.col("node").alias("root"), F.col("root").alias("up")), "root")
        now = materialise(spark, skew_join(labels, above, "root", "m", "node", total).select("node", "root", F.coalesce("up", "root").alias("up"), "n"), "parents")
        near = skew_join(both, now.select(F.col("node").alias("v"), "up", "n"), "v", "n", "u", total).groupBy(F.col("u").alias("node")).agg(F.min("up").alias("low"))
        met = materialise(spark, now.join(near, "node").select("node", "root", "n", F.least("up", "low").alias("low")), "lows")
        hooks = met.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        fresh = met.join(hooks, "node", "left").select("node", F.least("root", "low", "hook").alias("root"), "n", F.col("root").alias("was"))
        fresh = materialise(spark, fresh, "labels")
        labels = fresh.select("node", "root", "n")
        if not fresh.where("root <> was").limit(1).count():
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
