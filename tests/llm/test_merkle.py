"""Merkle manifests against a plain reading of the trees, proofs that verify or fail, and odd tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from daybook.llm import merkle
from daybook.llm.queries import QUERIES, SQL, table

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, g string, idx long, digest string, n long, name string, block int, key string, row int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity):
    """The levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, place, arity):
    for nodes in levels[:-1]:
        start = place - place % arity
        yield nodes[start:place], nodes[place + 1 : start + arity]
        place //= arity


def brute(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    trees = {}
    for r in rows:
        low = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and low is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in low)
        trees.setdefault(r[1], []).append((r[0], H(*map(field, r)), H(*map(field, (*r[:4], low)))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    own = {s: climb([x[1] for x in trees[s]], arity) for s in order}
    top = climb([own[s][-1][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, other) in enumerate(trees[s]):
            proof = [*siblings(own[s], i, arity), *siblings(top, k, arity)]
            folded = other
            for before, after in proof:
                folded = H(*before, folded, *after)
            out.append((doc_id, leaf, own[s][-1][0], top[-1][0], H(*(x for p in proof for side in p for x in side)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "=x", 7, "d", 2, "m", 3, "k", 5) for r in rows], SCHEMA)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    return sorted((tuple(r[:7]) for r in merkle.manifest(spark, df, tampered={"text": low}, **more).collect()), key=str)


@pytest.mark.parametrize("arity, most", [(2, 1), (3, 2), (16, 2)])
def test_equals_a_plain_reading(spark, arity, most):
    sizes = {"hot": 300, "b": 17, "c": 16, "d": 1, "é": 33, None: 5, "": 2}
    rows = [(i, s, "en", i, f"Text {i} OF {s}") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    found = got(spark, rows, arity=arity, round_levels=most)
    assert found == brute(rows, arity)
    assert any(not r[6] for r in found) and any(r[6] for r in found)


def test_many_sources_make_a_deep_tree_of_their_own(spark):
    rows = [(i, f"s{i % 90}", None, None, "T") for i in range(200)]
    assert got(spark, rows, arity=2, round_levels=2) == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(1, "a", None, None, None), (1, "a", None, None, ""), (1, "a", None, None, ""), (1, "a", None, None, ""), (None, "a", "x", 3, "A" * 100_000), (None, "a", "x", 3, "B"), (None, None, None, None, None), (5, "-", "ü", -1, "日本 É"), (7, "=", "", 0, "nul\0Z")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, arity=2, round_levels=1) == brute(rows, 2)
    assert got(spark, []) == []
    alone = got(spark, [(3, "z", "l", 1, "only")])
    assert alone == brute([(3, "z", "l", 1, "only")]) and alone[0][1] == alone[0][3] and alone[0][4] == H()


def test_proofs_verify_their_leaf_and_no_other(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "en", i, f"t{i}", *"=x", 7, "d", 2, "m", 3, "k", 5)[:5] for i in range(120)], "doc_id long, source string, lang string, n_chars int, text string")
    rows = merkle.manifest(spark, df, with_proofs=True, arity=4).collect()
    assert all(r.verified and merkle.fold_proof(r.leaf, r.proof) == r.root for r in rows)
    assert not any(merkle.fold_proof(a.leaf, b.proof) == a.root for a, b in zip(rows, rows[1:], strict=False))


def test_query_equals_a_plain_reading_of_the_table(spark, sf):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, sf).collect()), key=str) == brute(rows)
    assert "op12_merkle_manifest" in SQL
