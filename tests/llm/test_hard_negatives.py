"""Hard negatives against brute force in whole numbers, and on odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, key long, vector string, score long, ab int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (id, components, label) in the order of their keys."""
    use = [(k, i, [math.floor(256 * x) for x in e], label) for k, (i, e, label) in enumerate(rows) if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, i, e, label in use:
        if i is None or i % 100:
            continue
        first = sorted((-dot(e, o), math.inf if j is None else j, q, j) for q, j, o, lab in use if lab == label and q != k)[:positives]
        for p, _, _, positive in first:
            other = sorted((-dot(e, o), math.inf if j is None else j, q, j) for q, j, o, lab in use if lab != label and low * -p <= 100 * dot(e, o) <= high * -p)
            out += [(i, positive, rank, j, -p, -s) for rank, (s, _, _, j) in enumerate(other[:negatives], 1)]
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).coalesce(1)
    found = hn.hard_negatives(spark, df, F.col("vec_id") % 100 == 0, **more)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("dimension, largest", [(1, 1), (3, 300), (64, 256), (700, 1 << 20), (40, 1 << 27), (257, 0)])
def test_residue_scores_are_exact(dimension, largest):
    draw = np.random.default_rng(dimension)
    a, b = (draw.integers(-largest, largest, (n, dimension), endpoint=True) for n in (7, 11))
    a[0], b[0], b[1] = largest, largest, -largest  # the bound itself, of either sign
    primes = hn.moduli(dimension, largest)
    assert all(min(dimension, hn.SLICE) * (p // 2) ** 2 <= hn.FLOAT32_EXACT for p in primes)
    assert hn.residue_scores(a, b, primes).tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(ArithmeticError):
        hn.moduli(64, 1 << 30)


def test_equals_brute_force_over_many_blocks_with_ties(spark):
    draw = random.Random(5)
    common = [0.5, -0.25, 0.125]
    rows = [(i, common if i % 3 == 0 else [draw.uniform(-1, 1) for _ in range(3)], draw.randrange(3)) for i in range(0, 1200, 4)]
    want = brute(rows)
    assert len(want) > 100
    assert got(spark, rows) == want
    assert got(spark, rows, row_block=17, anchor_block=2) == want
    assert got(spark, rows, row_block=40, positives=2, negatives=3, low=10, high=100) == brute(rows, 2, 3, 10, 100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    plain = [(100, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.4], 1), (3, [0.5, 0.2], 2), (4, [0.5, 0.2], 2)]
    odd = [(200, None, 1), (300, [1.0, nan], 1), (5, [inf, 0.0], 2), (6, [None, 1.0], 2), (7, [0.4, 0.4], None), (None, [0.5, 0.2], 2), (None, [1.0, 0.1], 1), (100, [1.0, 0.5], 1), (8, [], 1), (9, [0.6], 2), (400, [], 2), (10, [0.5, 0.1, 9.0], 3)]
    want = brute(plain + odd)
    assert want and got(spark, plain + odd) == want
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0], 1)]) == []


def test_query_equals_brute_force_of_the_table(spark, sf):
    from daybook.llm.queries import QUERIES, table

    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, sf, "embeddings").collect()]
    found = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in QUERIES["op11_hard_negatives"](spark, sf).collect()), key=str)
    assert found == brute(rows) and found
