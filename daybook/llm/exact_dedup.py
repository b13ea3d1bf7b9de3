"""Exact deduplication with a log-structured merge index over text digests.

Each task fills a memtable (digest -> greatest id, least id, count) of bounded size and flushes it as
a sorted run; runs are Parquet with Bloom filters on the digest. Compaction merges the runs by digest.
Rows that hit a compacted digest of two or more rows then have their bytes compared with the text of
the row that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, materialise, new_path, prune_filter, skew_join, text_of, with_row_key, without_rows

#: Digests a memtable holds before it is flushed as a run.
MEMTABLE_ROWS = 200_000
#: Tasks that share the byte verification of a hot group.
SALTS = 64
RUN = "digest string, run int, low long, high long, n long"


def flush_runs(batches: Iterator[pd.DataFrame], memtable_rows: int = MEMTABLE_ROWS) -> Iterator[pd.DataFrame]:
    """Memtables of one task, each flushed as a run sorted by digest."""
    table: dict[str, list] = {}
    run = 0

    def flush() -> pd.DataFrame:
        keys = sorted(table)
        rows = [table[k] for k in keys]
        return pd.DataFrame({"digest": keys, "run": run, "low": pd.array([r[0] for r in rows], "Int64"), "high": pd.array([r[1] for r in rows], "Int64"), "n": [r[2] for r in rows]})

    for pdf in batches:
        for digest, low, high, n in zip(pdf["digest"], pdf["low"], pdf["high"], pdf["n"], strict=True):
            low, high = (None if x != x else int(x) for x in (low, high))
            row = table.get(digest)
            if row is None:
                table[digest] = [low, high, n]
                if len(table) >= memtable_rows:
                    yield flush()
                    table.clear()
                    run += 1
            else:
                row[0] = low if row[0] is None else row[0] if low is None else min(row[0], low)
                row[1] = high if row[1] is None else row[1] if high is None else max(row[1], high)
                row[2] += n
    if table:
        yield flush()


class DigestIndex:
    """The levels of the index: runs as flushed, and the one compacted level, both in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "digest-index")

    def _write(self, df: DataFrame, level: str, mode: str) -> None:
        df.write.mode(mode).option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(MEMTABLE_ROWS)).parquet(f"{self.path}/{level}")

    def flush(self, rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DigestIndex:
        """Add rows (id long, digest string) as sorted runs of memtables."""
        entries = rows.select("digest", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("n"))
        self._write(entries.mapInPandas(lambda it: flush_runs(it, memtable_rows), RUN), "runs", "append")
        return self

    def compact(self) -> DataFrame:
        """Merge all runs: (digest, low, high, n), each digest once. A run has a digest once at most, so
        a hot digest brings one row for each memtable, not one for each document."""
        runs = self.spark.read.schema(RUN).parquet(f"{self.path}/runs")
        merged = runs.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self._write(merged, "compact", "overwrite")
        return self.level()

    def level(self) -> DataFrame:
        return self.spark.read.schema("digest string, low long, high long, n long").parquet(f"{self.path}/compact")

    def probe(self, digests: list[str]) -> DataFrame:
        """The compacted entries of a few digests (a batch of arrivals). The condition reaches the scan: row
        groups whose range or Bloom filter excludes all of them are not read."""
        return self.level().where(F.col("digest").isin(digests))


def exact_dedup(spark: SparkSession, docs: DataFrame, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Which rows of docs (doc_id long, text string) are copies of which.

    Returns one row for each input row: doc_id, keep_id, group_size, kept, text_sha256, verified (the
    bytes were compared and are equal; null for rows without a copy). keep: 'min' or 'max', the row
    of a group that stays.

    Null text counts as empty; empty texts are equal to each other. Of repeated rows with the same id
    and text, one stays. A null id never stays while its group has another id. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = text_of(docs, F.col("doc_id").cast("long").alias("id"))
    hashed = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    slim = hashed.select("id", "digest")
    level = DigestIndex(spark).flush(slim, memtable_rows).compact()
    total = level.agg(F.sum("n")).first()[0] or 0
    stays = F.col("high" if keep == "max" else "low")
    groups = materialise(spark, level.where("n > 1").select("digest", stays.alias("keep_id"), F.col("n").alias("group_size")), "dup-groups")

    found = skew_join(slim, groups, "digest", "group_size", "id", total)
    found = found.withColumn("_nth", F.row_number().over(Window.partitionBy("id", "digest").orderBy("digest")))
    found = found.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_nth") == 1).alias("_first"),
        F.col("digest").alias("text_sha256"),
    )
    found = found.withColumn("kept", F.col("_first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).drop("_first")

    # Byte verification, of hits only: the filter keeps the other texts out of the shuffle, in which each text
    # goes once. A group's head is the text that a partial aggregate meets first; that of a hot group is copied to
    # SALTS tasks, among which its members are dealt out.
    hot = groups.where(F.col("group_size") * HOT_KEYS >= total).select("digest", F.lit(True).alias("hot"))
    hits = hashed.where(prune_filter(groups, "digest")).join(F.broadcast(hot), "digest", "left")
    heads = hits.groupBy("digest").agg(F.first("text").alias("head"), F.first("hot").alias("hot"))
    heads = heads.select("digest", "head", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    members = hits.select("digest", "text", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    bad = members.join(heads, ["digest", "salt"], "left").where("head is null or cast(head as binary) <> cast(text as binary)")
    if bad.limit(1).count():
        raise RuntimeError("two different texts have one sha256 digest")
    return found.withColumn("verified", F.when(F.col("group_size") > 1, F.lit(True)))


def keep_first_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of docs that stay, with all their columns: of each group of equal texts the one of the least doc_id,
    and one without an id only where no row of the group has one.

    Rows are told apart by a key of their own, so those that share an id, or have none, go or stay by their own
    text, and of repeated rows one stays. Null text is equal to an empty one. Columns may have any names; an
    empty table stays empty. No text is shuffled but those that have copies, for verification.
    """
    keyed, row = with_row_key(spark, docs)
    found = exact_dedup(spark, keyed.select(F.col(row).alias("doc_id"), "text")).where("group_size > 1")
    ids = keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    copies = materialise(spark, found.select(F.col("doc_id").alias("row"), F.col("text_sha256").alias("digest")).join(ids, "row"), "copies")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    groups = materialise(spark, copies.groupBy("digest").agg(F.min(order)["row"].alias("stays"), F.count("*").alias("n")), "copy-heads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    gone = skew_join(copies, groups, "digest", "n", "row", total).where("row <> stays").select(F.col("row").alias(row))
    return without_rows(spark, keyed, gone, row).select(*docs.columns)
