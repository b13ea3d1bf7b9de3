"""The segmented index equals a rebuild after any batches, reads only what it must, and survives a crash."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daybook.operators import search
from daybook.sources import segments
from daybook.sources.segments import SegmentedIndex

WORDS = ["an", "ben", "chi", "công", "ty", "đọc", "sách", "family", "families", "work"]


def frame(spark, rows, columns="id string, body string"):
    return spark.createDataFrame(rows, columns)


def found(index, query):
    ranked = sorted((r.id, round(r.score, 9)) for r in search.bm25(index, query).collect())
    return ranked, [r.id for r in search.phrase(index, query).collect()], [r.id for r in search.full_text(index, query).collect()]


def test_equals_a_rebuild_after_adds_edits_and_deletes(spark, tmp_path):
    draw, index, now = random.Random(2), SegmentedIndex(spark, f"file://{tmp_path}/s", fanout=2, slots=3), {}
    body = lambda: " ".join(draw.choices(WORDS, k=draw.randrange(12)))
    for batch in range(4):
        puts = {f"e{draw.randrange(30)}": body() for _ in range(9)}
        outs = {f"e{draw.randrange(40)}" for _ in range(batch * 2)}
        version = index.apply(frame(spark, list(puts.items())), frame(spark, [(i,) for i in outs], "id string"))
        now = {**{k: v for k, v in now.items() if k not in outs}, **puts}
        assert version == index.version()[0]
    rebuilt = search.build_index(spark, frame(spark, list(now.items())), f"file://{tmp_path}/r")
    opened = index.open()
    assert [tuple(r) for r in opened.stats.collect()] == [tuple(r) for r in rebuilt.stats.collect()]
    for query in ("công ty family", "doc sach", "fami"):
        assert found(opened, query) == found(rebuilt, query)
    levels = [p.level for p in index.version()[1] if p.kind == "segment"]
    assert max(levels) >= 1 and all(levels.count(k) < 2 for k in levels)
    assert sum(p.n for p in index.version()[1] if p.kind == "segment") - sum(p.n for p in index.version()[1] if p.kind == "deleted") == len(now)


def test_sync_indexes_only_what_changed(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/s")
    first = [("a", "one two"), ("b", "two"), ("c", None)]
    assert index.sync(frame(spark, first)) == 1 and index.sync(frame(spark, first)) == 1
    assert index.sync(frame(spark, [("a", "one two"), ("b", "three"), ("d", "four")])) == 2
    _, parts = index.version()
    assert sorted((p.kind, p.n) for p in parts) == [("deleted", 2), ("segment", 2), ("segment", 3)]
    assert [r.id for r in search.bm25(index.open(), "two").collect()] == ["a"]
    assert index.sync(frame(spark, [])) == 3 and index.live().count() == 0 and search.bm25(index.open(), "two").count() == 0


def test_only_touched_segments_and_slots_are_read(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/s", fanout=9, slots=4)
    for k in range(3):
        index.apply(frame(spark, [(f"{k}-{i}", f"word{k} shared{i}") for i in range(20)]))
    names = [p.name for p in index.version()[1]]
    assert all(names[1] in f for f in index.postings(names[1:2]).inputFiles()) and index.postings(names[1:2]).count() == 40
    version, parts = index.version()
    index.merge(names[:2], 1, version, parts)
    left = [p for p in index.version()[1] if p.kind == "segment"]
    assert sorted((p.level, p.n) for p in left) == [(0, 20), (1, 40)] and names[2] in [p.name for p in left]
    assert not any(n in f for n in names[:2] for f in index.open().postings.inputFiles())
    plan = index.live().where("slot in (1)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "(slot" in plan.split("PartitionFilters")[1]


def test_what_a_crash_leaves_behind_is_not_read(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, f"file://{tmp_path}/s")
    index.apply(frame(spark, [("a", "one"), ("b", "one two")]))
    with monkeypatch.context() as m:
        m.setattr(SegmentedIndex, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.apply(frame(spark, [("a", "two")]), frame(spark, [("b",)], "id string"))
    assert index.version()[0] == 1 and sorted(r.id for r in search.bm25(index.open(), "one").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        index.apply(frame(spark, [("x", "1"), ("x", "2")]))
    with pytest.raises(ValueError):
        index.apply(frame(spark, [(None, "1")]))
    assert index.version()[0] == 1


def test_a_segment_is_packed_by_token_and_leaves_out_what_is_gone(spark, tmp_path):
    """Rows are as many as tokens of a block, not of its entries: these were rows of their own, each shuffled and sorted at every merge."""
    index = SegmentedIndex(spark, f"file://{tmp_path}/s", fanout=2)
    stored = lambda: spark.read.parquet(*(str(p) for p in tmp_path.rglob(f"seg={index.version()[1][0].name}") if p.parent.name == "postings")).where("token is not null")
    rows = spark.range(300, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.lit("b a Đọc b").alias("body"))
    index.apply(rows)
    assert sorted(r.token for r in stored().collect()) == ["a", "b", "doc"]
    index.apply(rows.where("id % 2 = 0").withColumn("body", F.lit("a new")))
    assert [(p.kind, p.level, p.n, p.total) for p in index.version()[1]] == [("segment", 1, 300, 900)]
    assert stored().where("token = 'b'").select(F.size("places")).first()[0] == 300 and stored().count() == 5
    kept = index.open().postings.where("token = 'b'").select(F.col("entry_id").cast("int"), "tf", "len", "positions")
    assert sorted(map(tuple, kept.collect())) == [(i, 2, 4, [0, 3]) for i in range(1, 300, 2)]


def test_blocks_are_cut_by_their_tokens_and_hold_all_entries(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_TOKENS", 5)
    texts = [["a", "b"], ["b"], [], ["c"] * 7, ["a"], ["b", "a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(list("012345")), pa.array(["d"] * 6), pa.array(texts)], ["entry_id", "digest", "t"])
    found, blocks = {}, {}
    for r in (r for out in segments._invert(iter([batch])) for r in out.to_pylist()):
        if r["token"] is None:
            blocks[r["block"]] = (r["ids"], r["lens"])
        else:
            found[r["block"], r["token"]] = [(p >> 32, p & 0xFFFFFFFF) for p in r["places"]]
    assert sorted(blocks.values()) == [(["0", "1", "2"], [2, 1, 0]), (["3"], [7]), (["4", "5"], [1, 3])]
    assert sorted((blocks[b][0][0], t, p) for (b, t), p in found.items()) == [
        ("0", "a", [(0, 0)]), ("0", "b", [(0, 1), (1, 0)]), ("3", "c", [(0, k) for k in range(7)]), ("4", "a", [(0, 0), (1, 1)]), ("4", "b", [(1, 0), (1, 2)]),
    ]
