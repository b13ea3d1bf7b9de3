"""Merging over tables against plain walks and the plain rewriter; imports that fail midway and start again."""

import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import merging
from daybook.sources import notes, vault, writers
from daybook.streaming import importing


def walk(redirects):
    first = {}
    for s, t in redirects:
        if s is not None and t is not None:
            first[s] = min(first.get(s, t), t)
    first = {s: t for s, t in first.items() if s != t}
    out = {}
    for s in first:
        seen, at = set(), s
        while at in first and at not in seen:
            seen.add(at)
            at = first[at]
        out[s] = (None, True) if at in first else (at, False)
    return out


def test_redirects_end_where_a_walk_ends(spark):
    draw = random.Random(3)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(150)]
    star = [(f"s{i}", "hub") for i in range(300)] + [("hub", "end")]
    cycles = [("x", "y"), ("y", "x"), ("p", "q"), ("q", "r"), ("r", "p"), ("into", "p"), ("self", "self"), ("to-self", "self"), (None, "a"), ("a", None)]
    rest = [(f"r{draw.randrange(60)}", f"r{draw.randrange(60)}") for _ in range(50)]
    for rows in (chain + star + cycles + rest, [("a", "b")], []):
        got = {r.source: (r.target, r.cyclic) for r in merging.resolve(spark, spark.createDataFrame(rows, "source string, into string")).collect()}
        assert got == walk(rows)


def test_links_are_rewritten_as_by_the_plain_rewriter(spark):
    draw = random.Random(5)
    parts = ["[[An]]", "[[An|she]]", "[[ An |x]]", "[[Bo]]", "[[An]]]", "```\n[[An]]\n```", "~~~[[An]]~~~", "`[[An]]`", "```", "text ", "\n", "[[", "]]", "$1\\", ""]
    rows = [("".join(draw.choices(parts, k=draw.randrange(12))),) for _ in range(300)] + [(None,)]
    names = F.create_map(F.lit("An"), F.lit("Anna$1"))
    for r in spark.createDataFrame(rows, "body string").select("body", merging.rewrite_links(F.col("body"), names).alias("made")).collect():
        assert r.made == (r.body and notes.rewrite_links(r.body, "An", "Anna$1")[0]) or r.body == r.made == ""


def test_aliases_unite_in_order(spark):
    entities = spark.createDataFrame([("A", ["a", "x"], 1), ("B", ["x", "b", "A"], 2), ("C", None, 3), ("D", ["d"], 4), ("E", None, 5)], "name string, aliases array<string>, n int")
    resolved = spark.createDataFrame([("B", "A", False), ("C", "A", False), ("Gone", "A", False), ("D", None, True)], "source string, target string, cyclic boolean")
    got = {r.name: (r.aliases, r.n) for r in merging.merged_aliases(entities, resolved).collect()}
    assert got == {"A": (["a", "x", "b", "B", "C", "Gone"], 1), "D": (["d"], 4), "E": (None, 5)}
    links = spark.createDataFrame([("e1", "B"), ("e1", "D"), ("e2", "E")], "entry_id string, target string")
    assert sorted(r.target for r in merging.redirect_column(links, resolved, "target").collect()) == ["A", "D", "E"]
    bodies = spark.createDataFrame([("e1", "[[B|b]] [[D]]"), ("e2", "[[E]]")], "id string, body string")
    assert [tuple(r) for r in merging.rewritten_bodies(bodies, links, resolved).collect()] == [("e1", "[[A|b]] [[D]]")]


def test_an_import_that_fails_midway_loses_and_doubles_nothing(spark, tmp_path):
    block = lambda day, text, tags="": f"---\ntime: \"2026-01-{day:02d}T08:30:00Z\"\n{tags}---\n{text}\n"
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text(block(1, "One", "tags: [x]\n") + block(1, "Two") + block(2, "One") + block(2, "joy:: [[An]]\nThree"))
    root, ledger, checkpoint = str(tmp_path / "v"), f"file://{tmp_path}/ledger", f"file://{tmp_path}/checkpoint"
    writers.init_vault(root)
    done = []

    def fails(blocks, number):
        for k, r in enumerate(blocks.orderBy("path", "pos").collect()):
            if k == 2:
                raise OSError("lost")
            writers.append_once(root, r.date, r.time, writers.with_tags(r.text, r.tags), r.mood)
            done.append(number)

    with pytest.raises(Exception, match="lost"):
        importing.import_stream(spark, f"file://{tmp_path}/in", ledger, checkpoint, fails).awaitTermination()
    assert done == [0, 0]
    importing.import_stream(spark, f"file://{tmp_path}/in", ledger, checkpoint, importing.into_notes(root)).awaitTermination()
    (tmp_path / "in/deep/b.md").write_text(block(3, "Two") + block(3, "Four"))
    for _ in range(2):
        importing.import_stream(spark, f"file://{tmp_path}/in", ledger, checkpoint, importing.into_notes(root)).awaitTermination()
    entries = vault.read_vault(spark, root).entries.collect()
    assert sorted((r.date, r.body) for r in entries) == [("2026-01-01", "One"), ("2026-01-01", "Two"), ("2026-01-02", "Three"), ("2026-01-03", "Four")]
    assert sorted((r.batch, r.status) for r in importing.read_ledger(spark, ledger).collect()) == [(0, "duplicate"), (0, "new"), (0, "new"), (0, "new"), (1, "known"), (1, "new")]


def test_the_log_of_an_import_is_kept_after_each_file(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "One"), ("b", "Two"), ("c", "Three")):
        (tmp_path / f"in/{name}.md").write_text(f"---\ntime: \"2026-01-02T08:30:00Z\"\n---\n{text}\n")
    root, real = str(tmp_path / "v"), writers.append_once
    writers.init_vault(root)

    def crash(vault_, day, time, text, mood=None):
        if text.startswith("Three"):
            raise KeyboardInterrupt
        return real(vault_, day, time, text, mood)

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(writers, "append_once", crash)
        vault.import_folder(spark, str(tmp_path / "in"), root)
    assert len(writers.read_import_log(root)) == 2
    assert vault.import_folder(spark, str(tmp_path / "in"), root)["entries_created"] == 1
    assert sorted(r.body for r in vault.read_vault(spark, root).entries.collect()) == ["One", "Three", "Two"]
