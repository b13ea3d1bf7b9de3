"""Hard negatives by exact integer scores: matrix products in residue number systems.

Components are integers. Each matrix is taken modulo several primes so small that a float32 product of
residues is exact; the signed scores come back by Chinese remaindering. Anchors and rows meet in blocks, a
group of bounded size for each pair of blocks. A first sweep finds each anchor's positives, a second one
the negatives inside the window of each positive's score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows and anchors of a block; a pair of blocks is one task's matrix product (some tens of megabytes).
ROW_BLOCK, ANCHOR_BLOCK = 2048, 512
#: Integers that float32 holds exactly, and the bound on scores, which are 64-bit.
FLOAT32_EXACT, SCORE_BOUND = 1 << 24, 1 << 62
#: Inner dimension that is multiplied at a time, so that primes need not get too small.
SLICE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
PICKED = "anchor long, anchor_id long, positive int, other long, other_id long, score long"


def primes_below(limit: int) -> list[int]:
    sieve = np.ones(limit, dtype=bool)
    sieve[:2] = False
    for i in range(2, int(limit**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return np.flatnonzero(sieve)[::-1].tolist()


def moduli(dimension: int, largest: int) -> list[int]:
    """The fewest large primes p with exact float32 products of symmetric residues (dimension * (p // 2)^2 is
    within float32), whose product covers all signed scores of vectors with components up to largest."""
    bound = max(1, dimension) * largest * largest
    if bound >= SCORE_BOUND:
        raise ArithmeticError("scores of these vectors don't fit into 64 bits")
    limit = 2 * int((FLOAT32_EXACT // max(1, min(dimension, SLICE))) ** 0.5)
    chosen, product = [], 1
    for p in primes_below(min(limit, 4096)):
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    return chosen


def symmetric(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p // 2) to p // 2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


def residue_scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """a @ b.T for int64 matrices, exact if the product of primes covers it."""
    digits: list[np.ndarray] = []  # mixed radix: score = d0 + d1 p0 + d2 p0 p1 + ...
    for k, p in enumerate(primes):
        left, right = symmetric(a, p).astype(np.float32), symmetric(b, p).astype(np.float32)
        r = np.zeros((len(a), len(b)), dtype=np.int64)
        for at in range(0, a.shape[1], SLICE):
            r += (left[:, at : at + SLICE] @ right[:, at : at + SLICE].T).astype(np.int64)
        weight = 1
        for q, d in zip(primes[:k], digits, strict=True):
            r -= np.mod(d.astype(np.int64), p) * weight
            weight = weight * q % p
        r = np.mod(r, p) * pow(weight, -1, p)
        digits.append(symmetric(r, p).astype(np.int16))
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for p, d in zip(reversed(primes), reversed(digits), strict=True):
        out = out * p + d  # symmetric digits: partial sums stay below half the primes' product
    return out


def first_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's first allowed scores: higher first, then smaller id, null ids last."""
    if scores.shape[1] > most:
        lowest = np.iinfo(np.int64).min
        masked = np.where(allowed, scores, lowest)
        cut = np.partition(masked, -most, axis=1)[:, -most]
        allowed = allowed & (scores >= cut[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((keys[col], ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - start[row] < most
    return row[keep], col[keep]


def matrix(table: pa.Table, dimension: int) -> np.ndarray:
    """Vectors as rows; short ones end in zeros."""
    lists = table.column("vector").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dimension), dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def sweep(dimension: int, primes: list[int], select: Callable) -> Callable[[pa.Table], pa.Table]:
    """A function of the rows of one pair of blocks, which gives what select picks from its scores."""

    def run(table: pa.Table) -> pa.Table:
        is_anchor = table.column("is_anchor")
        anchors, rows = table.filter(is_anchor), table.filter(pc.invert(is_anchor))
        if not len(anchors) or not len(rows):
            return pa.table({f.name: pa.array([], f.type) for f in PICKED_ARROW}, schema=PICKED_ARROW)
        scores = residue_scores(matrix(anchors, dimension), matrix(rows, dimension), primes)
        ids = rows.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        keys, labels = rows.column("key").to_numpy(), rows.column("label").to_numpy()
        parts = []
        same = anchors.column("label").to_numpy()[:, None] == labels
        for positive, allowed, most in select(anchors, scores, same, anchors.column("key").to_numpy()[:, None] == keys):
            r, c = first_of(scores, allowed, ids, keys, most)
            parts.append(pa.table([anchors.column("key").take(r), anchors.column("vec_id").take(r), pa.array(np.full(len(r), positive, np.int32)), pa.array(keys[c]), rows.column("vec_id").take(c), pa.array(scores[r, c])], schema=PICKED_ARROW))
        return pa.concat_tables(parts)

    return run


PICKED_ARROW = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive", pa.int32()), ("other", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])


def pick_positives(most: int) -> Callable:
    return lambda anchors, scores, same, itself: [(0, same & ~itself, most)]


def pick_negatives(most: int, positives: int, low: int, high: int) -> Callable:
    """Of other labels, with low * positive <= 100 * negative <= high * positive, for each positive."""

    def pick(anchors: pa.Table, scores: np.ndarray, same: np.ndarray, itself: np.ndarray):
        lists = anchors.column("positive_scores").to_pylist()
        for k in range(positives):
            p = [x[k] if x is not None and k < len(x) else None for x in lists]
            least = np.array([1 if x is None else -(-low * x // 100) for x in p], dtype=np.int64)[:, None]
            largest = np.array([0 if x is None else high * x // 100 for x in p], dtype=np.int64)[:, None]
            yield k, ~same & (scores >= least) & (scores <= largest), most

    return pick


def _first(picked: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first of what the blocks picked, numbered from 1."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other"))
    return picked.withColumn("nth", nth).where(F.col("nth") <= most)


def _met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Each block of anchors with each block of rows: all rows of the group (ab, rb)."""
    columns = ["ab", "rb", "is_anchor", "key", "vec_id", "label", "vector", "positive_scores"]
    side = anchors.withColumns({"is_anchor": F.lit(True), "rb": F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))}).select(*columns)
    other = rows.withColumns({"is_anchor": F.lit(False), "positive_scores": F.lit(None).cast("array<long>"), "ab": F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))}).select(*columns)
    return side.unionByName(other)


def integer_rows(spark: SparkSession, embeddings: DataFrame, label: Column) -> DataFrame:
    """(key, vec_id, label, vector of floor(256 * x)) of the rows that take part, written once."""
    x = embeddings["embedding"]
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = embeddings.where(embeddings["label"].isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("key"), embeddings["vec_id"].cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vector"))
    return materialise(spark, rows, "vectors")


def hard_negatives(
    spark: SparkSession, embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """The hard negatives of each anchor and positive of embeddings (vec_id, embedding, label): anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score, anchor_key and positive_key (their rows).

    An anchor's positives are its first rows of the same label but itself; negatives are rows of other labels
    whose score is from low to high per cent of the positive's. Higher scores come first, ties by smaller
    vec_id (null last), then in the order of rows. is_anchor is a condition on vec_id (null: no anchor), label
    an expression in place of the column.

    Rows with a null label, vector or component, or one that isn't finite, take no part. Rows that share an
    id are rows of their own: as anchors each brings its own results, and one may be the other's positive.
    Vectors of unequal length count as ending in zeros, empty ones as zero. Scores that may not fit into 64
    bits raise an ArithmeticError. An empty table gives an empty result; other columns are ignored.
    """
    rows = integer_rows(spark, embeddings, embeddings["label"] if label is None else label)
    facts = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a"), F.max(F.size("vector")).alias("d"), F.max(F.array_max(F.transform("vector", F.abs))).alias("m")).first()
    n_rows, n_anchors = max(1, -(-facts.n // row_block)), max(1, -(-facts.a // anchor_block))
    dimension = max(1, facts.d or 0)
    primes = moduli(dimension, facts.m or 1)
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    rows = rows.withColumn("rb", dealt(n_rows))
    anchors = rows.where(is_anchor).drop("rb").withColumn("ab", dealt(n_anchors))

    def picked(anchor_side: DataFrame, select: Callable) -> DataFrame:
        return _met(anchor_side, rows, n_anchors, n_rows).groupBy("ab", "rb").applyInArrow(sweep(dimension, primes, select), PICKED)

    none = F.lit(None).cast("array<long>")
    found = _first(picked(anchors.withColumn("positive_scores", none), pick_positives(positives)), ["anchor"], positives)
    found = materialise(spark, found.withColumn("positive", F.col("nth") - 1), "positives")
    scores = found.groupBy(F.col("anchor").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "score"))), lambda s: s["score"]).alias("positive_scores"))
    best = _first(picked(anchors.join(scores, "key"), pick_negatives(negatives, positives, low, high)), ["anchor", "positive"], negatives)
    with_positive = found.select("anchor", "positive", F.col("other").alias("positive_key"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(with_positive, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        F.col("anchor").alias("anchor_key"), "positive_key",
    )
