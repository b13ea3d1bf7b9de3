"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes a set of hashed word shingles and a MinHash signature. Texts with equal sets form
   a class, which has a number of its own and one text that stands for it from there on.
2. Signatures are cut into bands; classes that share a band are linked to the least of them, and
   connected components of these links are the neighbourhoods in which similar pairs lie.
3. A neighbourhood is dealt out over blocks of bounded size, classes with the same head together. Two
   blocks are candidates if some band has classes in both. A candidate pair of blocks is compared by one
   task: signatures chunk by chunk, dropping pairs whose posterior probability of reaching the threshold
   falls below a tolerance, then the exact similarity of the pairs that are left.
Candidates are pairs of blocks, not of classes, so a set of n classes that are all alike ships each of them
once for each of its n / (a block's classes) blocks. Tasks return counts and spanning links, never pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lean, materialise, prune_filter, skew_join, stream_groups, text_of, with_row_key, without_rows

WIDTH, THRESHOLD = 5, 0.8
#: 24 bands of 4: a pair at 0.8 shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
#: Pairs are dropped when the posterior probability of similarity >= threshold is below this.
TOLERANCE, CHUNK = 1e-7, 16
#: What a block holds: shingles, and CLASS_WEIGHT for each class (some 2,500 short texts, or 50 very long
#: ones). A task holds two blocks at a time and compares STEP by STEP of their classes at once.
BLOCK_WEIGHT, CLASS_WEIGHT, STEP = 1 << 20, 256, 512
WORD = re.compile(r"[^\W_]+")

_SEED = np.random.default_rng(20240607)
_MULTIPLY = _SEED.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_MIX = _SEED.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_HASHES = _Hashes()


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of width lower-cased words; a shorter text has one run, all its words."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    w = min(width, len(h))
    mixed = np.full(len(h) - w + 1, w, np.uint64)
    for k in range(w):
        mixed = (mixed ^ h[k : k + len(mixed)]) * _MIX[k]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least values of multiply-add hashes, their upper 32 bits."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        low = np.minimum(low, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def signature_rows(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, sigs, sizes = [], [], []
        for text in pdf["text"]:
            s = shingle_set(text, width)
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
            sigs.append(minhash(s).tobytes() if len(s) else None)
            sizes.append(len(s))
        yield pd.DataFrame({"r": pdf["r"], "place": pdf["place"], "mark": pdf["mark"], "key": keys, "len": sizes, "sig": sigs})


def shingle_rows(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The shingle set of each class, from the rows at its place; a row whose text has another set is no row of the class."""
    for pdf in batches:
        sets = [shingle_set(t, width).tobytes() for t in pdf["text"]]
        own = [hashlib.blake2b(s, digest_size=16).hexdigest() == k for s, k in zip(sets, pdf["key"], strict=True)]
        out = pdf[["rep", "size", "comp", "block"]].assign(set=sets)
        yield out[np.array(own, dtype=bool)]


def band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(band, rep): a 64-bit hash of the band's number and values."""
    for pdf in batches:
        if not len(pdf):
            continue
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), BANDS, ROWS).astype(np.uint64)
        h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for k in range(ROWS):
            h = (h ^ sig[:, :, k]) * _MIX[k]
            h = h ^ (h >> np.uint64(31))
        yield pd.DataFrame({"band": h.astype(np.int64).ravel(), "rep": np.repeat(pdf["rep"].to_numpy(), BANDS)})


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values: the least matches at which P(similarity >= threshold) >= tolerance,
    from a uniform prior. That posterior is P(Binomial(n + 1, threshold) <= matches)."""
    out = []
    for n in range(CHUNK, BANDS * ROWS + 1, CHUNK):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """Pairs (rows of a, rows of b) of signatures that no chunk dropped."""
    matches = np.zeros((len(a), len(b)), np.int16)
    alive = np.ones((len(a), len(b)), bool)
    for step, least in enumerate(least_matches(threshold, tolerance)):
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            break
        for k in range(step * CHUNK, (step + 1) * CHUNK):
            matches[rows] += a[rows, k][:, None] == b[:, k][None, :]
        alive[rows] &= matches[rows] >= least
    return alive


def exact_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], alive: np.ndarray, threshold: float) -> np.ndarray:
    """Which surviving pairs have exact Jaccard similarity >= threshold."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    out = np.zeros_like(alive)
    i, j = np.nonzero(alive)
    if not len(i):
        return out
    if len(i) <= 4 * (len(sets_a) + len(sets_b)):
        same = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        # Many pairs: only shingles found on both sides can be shared; count them by matrix products.
        ra, rb = np.unique(i), np.unique(j)
        flat_a, flat_b = np.concatenate([sets_a[x] for x in ra]), np.concatenate([sets_b[y] for y in rb])
        shared = np.intersect1d(flat_a, flat_b)
        rows_a, rows_b = np.repeat(np.arange(len(ra)), size_a[ra]), np.repeat(np.arange(len(rb)), size_b[rb])
        at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
        ok_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
        ok_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
        counts = np.zeros((len(ra), len(rb)), np.float32)
        for at in range(0, len(shared), 4096):
            ma, mb = np.zeros((len(ra), 4096), np.float32), np.zeros((len(rb), 4096), np.float32)
            for m, rows, cols, ok in ((ma, rows_a, at_a, ok_a), (mb, rows_b, at_b, ok_b)):
                pick = ok & (cols >= at) & (cols < at + 4096)
                m[rows[pick], cols[pick] - at] = 1
            counts += ma @ mb.T
        same = counts[np.searchsorted(ra, i), np.searchsorted(rb, j)].round().astype(np.int64)
    good = same >= threshold * (size_a[i] + size_b[j] - same) - 1e-9
    out[i[good], j[good]] = True
    return out


class _Roots:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def compare_groups(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """For each (comp, i, j) pair of blocks, a row for each class that has links there: the number of linked
    texts and documents, and a class it is connected to."""
    for (_, bi, bj), g in stream_groups(batches, ["comp", "i", "j"]):
        g = g.sort_values("rep", ignore_index=True)
        sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
        sigs = np.stack([minhash(s) for s in sets])
        block, size, rep = g["block"].to_numpy(), g["size"].to_numpy(), g["rep"].to_numpy()
        a = np.flatnonzero(block == bi)
        b = a if bi == bj else np.flatnonzero(block == bj)
        if not len(a) or not len(b):
            continue
        links = np.zeros(len(g), np.int64)
        docs = np.zeros(len(g), np.int64)
        roots = _Roots(len(g))
        for at in range(0, len(a), STEP):
            for to in range(at if bi == bj else 0, len(b), STEP):
                pa_, pb_ = a[at : at + STEP], b[to : to + STEP]
                alive = surviving(sigs[pa_], sigs[pb_], threshold)
                alive &= pa_[:, None] < pb_[None, :] if bi == bj else True
                ok = exact_links([sets[x] for x in pa_], [sets[y] for y in pb_], alive, threshold)
                links[pa_] += ok.sum(1)
                links[pb_] += ok.sum(0)
                docs[pa_] += ok @ size[pb_]
                docs[pb_] += ok.T @ size[pa_]
                for x, y in zip(*np.nonzero(ok), strict=True):
                    roots.join(int(pa_[x]), int(pb_[y]))
        hit = np.flatnonzero(links)
        if len(hit):
            yield pd.DataFrame({"rep": rep[hit], "links": links[hit], "docs": docs[hit], "to": rep[[roots.find(int(x)) for x in hit]]})


def neighbourhoods(spark: SparkSession, classes: DataFrame, bands: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the block of every class that shares a band with another (rep, comp, block), and
    the pairs of blocks that share a band (comp, i, j, i <= j)."""
    buckets = materialise(spark, bands.groupBy("band").agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = materialise(spark, skew_join(bands, buckets, "band", "n", "rep", total * BANDS).where("u is not null").select("band", "rep", "u"), "shared-bands")
    # A class links to the least head among its bands, and that head to the others: heads repeat, so what
    # is left after distinct is about one link for each class, not one for each band.
    heads = shared.groupBy("rep").agg(F.min("u").alias("head"), F.collect_set("u").alias("heads"))
    heads = materialise(spark, heads, "heads")
    own = heads.where("head <> rep").select("head", F.col("rep").alias("v"))
    among = heads.select("head", F.explode("heads").alias("v")).where("head <> v").distinct()
    comps = components(spark, own.union(among).select(F.col("head").alias("u"), "v"))

    placed = heads.select("rep", "head").join(comps.withColumnRenamed("node", "rep").withColumnRenamed("root", "comp"), "rep")
    placed = materialise(spark, placed.join(classes.select("rep", (F.col("len") + CLASS_WEIGHT).alias("weight")), "rep"), "placed")
    # Heads whose classes fill blocks get blocks of their own; the others of a component share some.
    crowds = placed.groupBy("comp", "head").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    crowds = crowds.withColumn("own", F.when(F.col("w") > BLOCK_WEIGHT, F.ceil(F.col("w") / BLOCK_WEIGHT)).otherwise(0))
    crowds = materialise(spark, crowds.select("comp", "head", "w", "n", "own"), "crowds")
    rest = crowds.groupBy("comp").agg(F.ceil(F.sum(F.when(F.col("own") == 0, F.col("w")).otherwise(0)) / BLOCK_WEIGHT).alias("rest"), F.count("*").alias("m"))
    rest = skew_join(crowds, materialise(spark, rest, "crowd-blocks"), "comp", "m", "head", max(1, total)).select("head", "comp", "own", "rest", "n")
    by_head = materialise(spark, rest.withColumnRenamed("comp", "c"), "head-blocks")  # a head lies in one component
    found = skew_join(placed.select("rep", "comp", "head"), by_head, "head", "n", "rep", max(1, total))
    common = F.pmod(F.xxhash64("head"), F.greatest("rest", F.lit(1)))
    block = F.when(F.col("own") == 0, F.concat(F.lit("c"), common)).otherwise(F.concat_ws("-", F.lit("h"), "head", F.pmod(F.xxhash64("rep"), F.greatest("own", F.lit(1)))))
    members = materialise(spark, found.select("rep", "comp", F.xxhash64(block).alias("block")), "members")

    # Blocks that share a band: distinct (band, block) first, so a hot band has a row for each of its blocks.
    counts = members.join(shared.select("rep", "band"), "rep").select("band", "comp", "block").distinct()
    counts = materialise(spark, counts, "band-blocks")
    many = counts.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    sides = counts.join(many, "band", "left_semi")
    other = sides.select("band", F.col("block").alias("other"))
    across = sides.join(other, "band").where("block < other").select("comp", F.col("block").alias("i"), F.col("other").alias("j"))
    within = members.groupBy("comp", "block").agg(F.count("*").alias("k")).where("k > 1").select("comp", F.col("block").alias("i"), F.col("block").alias("j"))
    return members, materialise(spark, across.union(within).distinct(), "block-pairs")


def near_join(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, class_size, group_id, n_links, n_texts.

    A class is the rows with one set of word shingles; class_id is its least id, class_size its number
    of rows; n_texts is the number of other classes with Jaccard similarity >= threshold, and n_links
    the number of other rows that are so similar (those of the own class too); group_id is the least
    class_id of the connected component.

    Classes are of texts, not of ids: rows that share an id but not their text are compared each for
    itself, and so are rows without an id (class_id is null only where no row of the class has one,
    group_id where none of the group has). Null text counts as empty. A text without words has no
    shingles and is like no other: its class and group are itself (class_size 1). A text of fewer than
    width words has one shingle, all of them. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = text_of(docs, F.col("doc_id").cast("long").alias("id"))
    # place and mark tell the row that stands for a class: its least id (none comes last), and its text.
    none = F.lit((1 << 63) - 1)
    rows = rows.select(F.coalesce("id", none).alias("place"), F.md5(F.col("text").cast("binary")).alias("mark"), "text")
    asked = rows.withColumn("r", F.monotonically_increasing_id())
    signed = asked.mapInPandas(lean(lambda it: signature_rows(it, width)), "r long, place long, mark string, key string, len long, sig binary")
    signed = materialise(spark, signed, "signatures").withColumn("id", F.when(F.col("place") != none, F.col("place")))
    classes = signed.where("key is not null").groupBy("key").agg(
        F.min(F.struct("place", "mark")).alias("first"), F.min("id").alias("low"), F.count("*").alias("size"), F.first("len").alias("len"), F.first("sig").alias("sig"),
    )
    classes = classes.select("key", "first.place", "first.mark", "low", "size", "len", "sig", F.monotonically_increasing_id().alias("rep"))
    classes = materialise(spark, classes, "classes")
    total = max(1, classes.agg(F.sum("size")).first()[0] or 0)
    bands = materialise(spark, classes.select("rep", "sig").mapInPandas(band_rows, "band long, rep long"), "bands")
    members, pairs = neighbourhoods(spark, classes, bands, total)

    wanted = materialise(spark, members.join(classes.select("rep", "key", "place", "mark", "size"), "rep").withColumn("spot", F.xxhash64("place", "mark")), "wanted")
    passing = rows.withColumn("spot", F.xxhash64("place", "mark")).where(prune_filter(wanted, "spot")).select("place", "mark", "text").dropDuplicates(["place", "mark"])
    sets = passing.join(wanted, ["place", "mark"]).select("rep", "size", "comp", "block", "key", "text")
    sets = sets.mapInPandas(lean(lambda it: shingle_rows(it, width)), "rep long, size long, comp long, block long, set binary")
    sides = pairs.select("comp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sides = sides.groupBy("comp", "block").agg(F.collect_list(F.struct("i", "j")).alias("with"))
    dealt = sets.join(sides, ["comp", "block"]).withColumn("p", F.explode("with")).select("comp", "p.i", "p.j", "block", "rep", "size", "set")
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = materialise(spark, dealt.mapInPandas(lean(lambda it: compare_groups(it, threshold)), "rep long, links long, docs long, to long"), "links")

    groups = components(spark, found.select(F.col("rep").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "rep")
    groups = materialise(spark, groups.join(classes.select("rep", "low"), "rep"), "groups")
    names = materialise(spark, groups.groupBy("root").agg(F.min("low").alias("group_id"), F.count("*").alias("n")), "group-names")
    named = skew_join(groups.select("rep", "root"), names, "root", "n", "rep", total).select("rep", "group_id")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs")).join(named, "rep")
    full = classes.join(linked.withColumn("grouped", F.lit(True)), "rep", "left").select(
        "key", F.col("low").alias("class_id"), F.col("size").alias("class_size"), F.when(F.col("grouped"), F.col("group_id")).otherwise(F.col("low")).alias("group_id"),
        (F.coalesce("docs", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_texts"),
    )
    zero = F.lit(0).cast("long")
    alone = signed.where("key is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.col("id").alias("group_id"), zero.alias("n_links"), zero.alias("n_texts"))
    joined = skew_join(signed.where("key is not null").select("r", "id", "key"), materialise(spark, full, "classes"), "key", "class_size", "r", total)
    return joined.select(F.col("id").alias("doc_id"), "class_id", "class_size", "group_id", "n_links", "n_texts").unionByName(alone)


def one_of_each_group(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row of docs of each group, with all its columns: the one of the least doc_id, and one without an
    id only where no row of the group has one.

    Rows are told apart by a key of their own, so those that share an id, or have none, are compared
    like all others, and of repeated rows one stays. Texts without words (null ones too) stay. Columns
    may have any names; an empty table stays empty.
    """
    keyed, row = with_row_key(spark, docs)
    found = near_join(spark, keyed.select(F.col(row).alias("doc_id"), "text"), threshold, width)
    linked = found.where("n_links > 0").select(F.col("doc_id").alias("row"), "group_id")
    ids = keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    linked = materialise(spark, linked.join(ids, "row"), "near-groups")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    groups = materialise(spark, linked.groupBy("group_id").agg(F.min(order)["row"].alias("stays"), F.count("*").alias("n")), "near-heads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    gone = skew_join(linked, groups, "group_id", "n", "row", total).where("row <> stays").select(F.col("row").alias(row))
    return without_rows(spark, keyed, gone, row).select(*docs.columns)
