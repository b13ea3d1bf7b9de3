"""An inverted index that is kept up to date: immutable segments, delete vectors, merges in levels.

A batch of entries becomes a segment of postings and documents that never changes. What the batch replaces
or takes out is written as a delete vector: rows of an older segment that no longer count. When a level has
a number of segments, they are merged to one of the next level, without the rows that are gone. A manifest
row for each live segment and vector makes a version; it is written last, so what a crash leaves behind is
never read. One writer at a time.

Postings are stored packed: entries lie in blocks, and a row holds all of a token's places in a block. So a token's
entries are shuffled, sorted and merged together, and become rows of their own only when they are searched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.search import STATS, bucket_of
from ..operators.tables import Index

MANIFEST = "version int, kind string, name string, level int, n bigint, total bigint"
#: A place is an entry's number in its block (high half) and the token's number in the entry, in ascending order.
#: A block's entries are a row in a bucket of their own, with a null token; a task writes them with their postings, or neither.
PACKED = "token string, block bigint, places array<bigint>, ids array<string>, lens array<int>, digests array<string>"
ENTRIES = -1
DOCUMENTS = "entry_id string, len int, digest string, block bigint, at int, seg string, slot int"
VECTOR = "seg string, entry_id string, len int, block bigint, at int, name string"
#: Tokens of a block, beyond which it takes no other entry.
BLOCK_TOKENS = 4_000_000
#: Segments of a level that are merged, and the parts of a segment's documents that a batch's ids select from.
FANOUT, SLOTS = 4, 16


@dataclass(frozen=True)
class Part:
    """A live segment or delete vector: its documents (n) and their tokens (total)."""

    kind: str
    name: str
    level: int
    n: int
    total: int


def slot_of(entry_id: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(entry_id), F.lit(slots)).cast("int")


def _block(ids: pa.Array, texts: pa.Array, digests: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each distinct token of a block, with its places; then one row of the block's entries."""
    lens, words = pc.list_value_length(texts).to_numpy(), texts.flatten().dictionary_encode()
    code, at = words.indices.to_numpy(), np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    places = at << 32 | np.arange(len(at)) - np.repeat(np.cumsum(lens, dtype=np.int64) - lens, lens)
    nth = np.sort(code.astype(np.int64) << 32 | np.arange(len(at))) & 0xFFFFFFFF  # by token, then in order
    block, n = uuid.uuid4().int >> 65, len(words.dictionary)  # 63 random bits
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    names = ["token", "block", "places", "ids", "lens", "digests"]
    ends = pa.array(np.append(0, np.cumsum(np.bincount(code, minlength=n))), pa.int32())
    told = [words.dictionary, pa.array(np.full(n, block)), pa.ListArray.from_arrays(ends, pa.array(places[nth]))]
    yield pa.RecordBatch.from_arrays([*told, pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.string()))], names)
    entries = [one(ids), one(pa.array(lens, pa.int32())), one(digests)]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block]), pa.nulls(1, pa.list_(pa.int64())), *entries], names)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (entry_id, t: their tokens, digest) as packed postings and blocks."""
    for b in batches:
        ids, texts, digests = (b.column(c) for c in ("entry_id", "t", "digest"))
        ends, start = np.cumsum(pc.list_value_length(texts).to_numpy(), dtype=np.int64), 0
        while start < len(ids):
            before = ends[start - 1] if start else 0
            n = max(1, int(np.searchsorted(ends, before + BLOCK_TOKENS, "right")) - start)
            yield from _block(ids.slice(start, n), texts.slice(start, n), digests.slice(start, n))
            start += n


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, slots: int = SLOTS):
        # An index of the older layout, a row for each token of each entry, isn't read: sync makes it anew.
        self.spark, self.path, self.fanout, self.slots = spark, path.rstrip("/") + "/packed", fanout, slots

    def version(self) -> tuple[int, list[Part]]:
        """The newest version and its parts: some for each level."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
            newest = rows.agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0, []
        return newest, [Part(r.kind, r.name, r.level, r.n, r.total) for r in rows.where(F.col("version") == newest).collect() if r.kind != "none"]

    def _commit(self, version: int, parts: list[Part]) -> None:
        rows = [(version, p.kind, p.name, p.level, p.n, p.total) for p in parts] or [(version, "none", "", 0, 0, 0)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self, what: str, schema: str, key: str, names: list[str]) -> DataFrame:
        """The parts of these names only; no other one is listed."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*(f"{self.path}/{what}/{key}={n}" for n in names))

    def packed(self, names: list[str]) -> DataFrame:
        rows = self._read("postings", PACKED + ", bucket int, seg string", "seg", names)
        return rows.where(F.col("bucket") != ENTRIES).select("token", "block", "places", "bucket", "seg")

    def blocks(self, names: list[str]) -> DataFrame:
        rows = self._read("postings", PACKED + ", bucket int, seg string", "seg", names)
        return rows.where(F.col("bucket") == ENTRIES).select("block", "ids", "lens", "digests", "seg")

    def postings(self, names: list[str]) -> DataFrame:
        """(token, entry_id, tf, len, positions, bucket, seg): a row for each distinct token of each entry."""
        rows = self.packed(names).join(self.blocks(names), ["seg", "block"])
        at = lambda i: F.shiftright(F.get("places", i), 32).cast("int")
        first = F.filter(F.transform("places", lambda p, i: F.when((i == 0) | (at(i - 1) != at(i)), i)), lambda i: i.isNotNull())
        tf = lambda i, k: F.coalesce(F.get("first", k + 1), F.size("places")) - i
        where = lambda i, k: F.transform(F.slice("places", i + 1, tf(i, k)), lambda p: p.bitwiseAND(0xFFFFFFFF).cast("int"))
        run = lambda i, k: F.struct(F.get("ids", at(i)).alias("entry_id"), tf(i, k).alias("tf"), F.get("lens", at(i)).alias("len"), where(i, k).alias("positions"))
        rows = rows.withColumn("first", first).select("token", "bucket", "seg", F.inline(F.transform("first", run)))
        return rows.select("token", "entry_id", "tf", "len", "positions", "bucket", "seg")

    def documents(self, names: list[str]) -> DataFrame:
        return self._read("documents", DOCUMENTS, "seg", names)

    def _gone(self, parts: list[Part]) -> DataFrame:
        return self._read("deleted", VECTOR, "name", [p.name for p in parts if p.kind == "deleted"]).drop("name")

    def _alive(self, rows: DataFrame, parts: list[Part]) -> DataFrame:
        if not any(p.kind == "deleted" for p in parts):
            return rows
        return rows.join(self._gone(parts).select("seg", "entry_id"), ["seg", "entry_id"], "left_anti")

    def _without_gone(self, packed: DataFrame, parts: list[Part]) -> DataFrame:
        """Packed rows without the places of entries that are gone; a block's are told as bits in one row."""
        if not any(p.kind == "deleted" for p in parts):
            return packed
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)))
        words = self._gone(parts).groupBy("seg", "block", F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        gone = words.groupBy("seg", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"), F.max("word").alias("last"))
        marks = gone.select("seg", "block", F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("bigint"))).alias("marks"))
        marked = lambda at: F.getbit(F.get("marks", F.shiftright(at, 6)), F.pmod(at, F.lit(64))) == 1
        kept = F.filter("places", lambda p: ~F.coalesce(marked(F.shiftright(p, 32).cast("int")), F.lit(False)))
        rows = packed.join(marks, ["seg", "block"], "left").withColumn("places", F.when(F.col("marks").isNull(), F.col("places")).otherwise(kept))
        return rows.where(F.size("places") > 0).select(packed.columns)

    def live(self, parts: list[Part] | None = None) -> DataFrame:
        """(entry_id, len, digest, block, at, seg, slot) of the documents that count."""
        parts = self.version()[1] if parts is None else parts
        return self._alive(self.documents([p.name for p in parts if p.kind == "segment"]), parts)

    def _write_segment(self, rows: DataFrame, level: int, name: str, docs: DataFrame | None = None) -> list[Part]:
        """Packed postings and blocks in partitions by bucket, and documents (those of the blocks if not given) by slot."""
        rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{self.path}/postings/seg={name}")
        if docs is None:
            own = self.blocks([name]).select("block", F.posexplode(F.arrays_zip("ids", "lens", "digests")).alias("at", "d"))
            docs = own.select(F.col("d.ids").alias("entry_id"), F.col("d.lens").alias("len"), F.col("d.digests").alias("digest"), "block", "at", slot_of(F.col("d.ids"), self.slots).alias("slot"))
        docs.hint("rebalance", "slot").sortWithinPartitions("slot", "entry_id").write.partitionBy("slot").parquet(f"{self.path}/documents/seg={name}")
        own = self.documents([name]).agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.count_distinct("entry_id").alias("ids")).first()
        if own.ids != own.n:
            raise ValueError("ids of a batch must be there, and there once")
        return [Part("segment", name, level, own.n, own.total or 0)] if own.n else []

    def _write_vector(self, rows: DataFrame) -> list[Part]:
        name = uuid.uuid4().hex
        rows.select("seg", "entry_id", "len", "block", "at").write.parquet(f"{self.path}/deleted/name={name}")
        own = self._read("deleted", VECTOR, "name", [name]).agg(F.count("*").alias("n"), F.sum("len").alias("total")).first()
        return [Part("deleted", name, 0, own.n, own.total or 0)] if own.n else []

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Add or replace entries (id, body), and take out those of deletes (id); returns the new version.

        Null bodies count as empty, and have no postings. An id that is both put and deleted is put; an id
        that isn't there is deleted without effect. Of a batch each id must be there once (ValueError).
        """
        version, parts = self.version()
        rows = upserts if upserts is not None else self.spark.createDataFrame([], "id string, body string")
        rows = rows.select(F.col("id").cast("string").alias("id"), F.coalesce("body", F.lit("")).alias("body"))
        ids = rows.select("id")
        if deletes is not None:
            ids = ids.union(deletes.select(F.col("id").cast("string")))
        fresh: list[Part] = []
        if any(p.kind == "segment" for p in parts):
            ids = ids.distinct().withColumn("slot", slot_of(F.col("id"), self.slots))
            touched = [r.slot for r in ids.select("slot").distinct().collect()]  # self.slots at most
            old = self.live(parts).where(F.col("slot").isin(touched)).join(ids.select(F.col("id").alias("entry_id"), "slot"), ["entry_id", "slot"], "left_semi")
            fresh += self._write_vector(old)
        if upserts is not None:
            texts = rows.select(F.col("id").alias("entry_id"), tokens(F.col("body")).alias("t"), F.md5(F.col("body").cast("binary")).alias("digest"))
            made = texts.mapInArrow(_invert, PACKED).withColumn("bucket", F.when(F.col("token").isNull(), ENTRIES).otherwise(bucket_of(F.col("token"))))
            fresh += self._write_segment(made, 0, uuid.uuid4().hex)
        self._commit(version + 1, parts + fresh)
        self._merge_levels()
        return self.version()[0]

    def _merge_levels(self) -> None:
        while True:
            version, parts = self.version()
            levels = [p.level for p in parts if p.kind == "segment"]
            full = [k for k in sorted(set(levels)) if levels.count(k) >= self.fanout]
            if not full:
                return
            self.merge([p.name for p in parts if p.kind == "segment" and p.level == full[0]], full[0] + 1, version, parts)

    def merge(self, names: list[str], level: int, version: int, parts: list[Part]) -> None:
        """One segment of these ones' live rows. Of the delete vectors only what hits other segments is kept."""
        rows = self._without_gone(self.packed(names), parts).drop("seg").hint("rebalance", "bucket")  # a large bucket is split among tasks
        blocks = self.blocks(names).drop("seg").withColumn("bucket", F.lit(ENTRIES))
        docs = self._alive(self.documents(names), parts).drop("seg")
        made = self._write_segment(rows.unionByName(blocks, allowMissingColumns=True), level, uuid.uuid4().hex, docs)
        if any(p.kind == "deleted" for p in parts):
            made += self._write_vector(self._gone(parts).where(~F.col("seg").isin(names)))
        self._commit(version + 1, [p for p in parts if p.kind == "segment" and p.name not in names] + made)

    def sync(self, entries: DataFrame) -> int:
        """Bring the index to these entries (id, body): only bodies whose digest is another are indexed."""
        stored = self.live().select(F.col("entry_id").alias("id"), F.col("digest").alias("was"))
        told = entries.select("id", "body", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("now"))
        changed = told.join(stored, "id", "left").where("was is null or was <> now").select("id", "body")
        gone = stored.join(told.select("id"), "id", "left_anti").select("id")
        if not changed.limit(1).count() and not gone.limit(1).count():
            return self.version()[0]
        return self.apply(changed, gone)

    def open(self) -> Index:
        """The live postings and the statistics of the live documents, for the search operators."""
        _, parts = self.version()
        rows = self._alive(self.postings([p.name for p in parts if p.kind == "segment"]), parts).drop("seg")
        n, total = (sum((1 if p.kind == "segment" else -1) * getattr(p, k) for p in parts) for k in ("n", "total"))
        return Index(rows, self.spark.createDataFrame([(n, total / max(n, 1))], STATS))
