"""Engine queries against SQL on a second engine, and scenarios on small authored notes."""

import json
from datetime import UTC, date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from daybook import cli
from daybook.functions import dates, similarity, text
from daybook.operators import analysis, search
from daybook.plans.catalogue import QUERIES, SQL
from daybook.operators.tables import Diary
from daybook.sources import notes, storage, vault, writers
from daybook.streaming.watch import watch

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = oracle.execute(SQL[name]).fetchdf()
    key = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[key].astype(object).where(d[key].notna(), None).astype(str).values.tolist()))
    assert sorted(got.columns) == key and rows(got) == rows(want)


TODAY = date(2026, 6, 30)


def test_dates():
    since = lambda s: (dates.parse_since(s, date(2026, 6, 12)) or (None,))[0]
    assert [since(s) for s in ("7d", "2w", "3m", "2026-01-05", "soon")] == ["2026-06-05", "2026-05-29", "2026-03-12", "2026-01-05", None]
    assert dates.months_back(date(2026, 3, 31), 1) == date(2026, 3, 3)
    told = lambda s: (dates.infer_event_date(s, TODAY) or (None,))[0]
    assert told("gặp ngày 5/6/2026") == "2026-06-05" and told("ngày 1 tháng 7") == "2025-07-01" and told("hôm qua") == "2026-06-29"
    assert told("thứ 2 tuần trước") == "2026-06-29" and told("chủ nhật vừa rồi") == "2026-06-28" and told("cuối tuần") == "2026-06-27"
    assert told("làm 3/4 việc") is None and told("30/2/2026 hôm kia") == "2026-06-28" and told("tháng trước") == "2026-05-30"
    assert told("tuần trướcx") is None and told("tháng trước_") is None and told("cuối tuần.") == "2026-06-27"
    assert dates.now_in("Asia/Ho_Chi_Minh", datetime(2026, 6, 30, 18, 5, tzinfo=UTC)) == ("2026-07-01", "01:05")
    assert not dates.is_iso_date("2026-02-30") and dates.middle("2026-01-01", "2026-01-04") == "2026-01-02"


def test_similarity():
    assert similarity.jaro_winkler("abc", "abc") == 1 and similarity.jaro_winkler("", "a") == 0
    assert similarity.jaro_winkler("ab", "ax") == pytest.approx(0.7)
    assert similarity.jaro_winkler("xxxxabc", "xxxxbca") == pytest.approx(0.9571, abs=1e-4)
    assert similarity.contained("Anh Đình", "dinh") and not similarity.contained("a b", "c")


def test_folding_matches_python(spark):
    words = ["Đình", "đường", "NHẬT BẢN", "áb", "Ñandú", "ø", "ß", "Å", "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("f")).collect()
    assert all(r.f == text.fold_text(r.w) for r in rows) and text.fold_text("Đường") == "duong"


def test_text_expressions(spark):
    body = "See [[A|b]] and [[ C ]] `[[no]]`\n```\n[[no]]\n```\n#tag a#b ##x C# #Năm"
    r = spark.createDataFrame([(body,)], "b string").select(text.wikilinks(F.col("b")).alias("l"), text.hashtags(F.col("b")).alias("h"), text.first_line(F.col("b"), 5).alias("f"), text.unlinked(F.col("b")).alias("u")).first()
    assert r.l == ["A", "C"] == notes.links_in(body) and r.h == ["tag", "Năm"] == notes.hashtags_in(body) and r.f == "See […" and r.u.startswith("See b and")
    assert text.asks_for_now("Hiện tại làm gì") and text.asks_for_now("I know") and not text.asks_for_now("before")


def test_entries_keep_their_text():
    body = "# t\n\n## 7:05\n\nmood:: happy/4\ntags:: a, b\njoy:: [[X]], [[Y|y]]\nsuperseded:: 2026-01-01#0\nText [[Z]] #c\n## 09:00 not a heading\n\n\n## 10:00\r\nmood:: so so\nmood:: bad/9\n\n"
    a, b = notes.parse_entries(body)
    assert (a["time"], a["mood"], a["intensity"], a["tags"], a["relations"], a["superseded"]) == ("7:05", "happy", 4, ["a", "b", "c"], {"joy": ["X", "Y"]}, "2026-01-01#0")
    assert a["text"] == "Text [[Z]] #c\n## 09:00 not a heading" and a["links"] == ["Z"]
    assert b["mood"] is None and b["text"] == "mood:: so so\nmood:: bad/9"


def test_checkins_and_link_rewriting():
    fields, warnings = notes.parse_checkin("sleep_hours=7.5, exercise=\"run, swim\",mood_score=x,=1,odd,k=")
    assert fields == {"sleep_hours": 7.5, "exercise": "run, swim", "mood_score": "x"} and len(warnings) == 4
    assert notes.rewrite_links("[[A|x]] [[A]] ```[[A]]``` [[B]]", "A", "C") == ("[[C|x]] [[C]] ```[[A]]``` [[B]]", 2)


def test_legacy_blocks(spark):
    raw = "# d\r\n---\r\ntime: \"2026-01-02T08:30:00+07:00\"\r\nmood: ok\r\ntags: ['a', \"b\", ]\r\n---\r\n\nOne\r\n---\nnot a block\n\n---\nmood: x\n---\n\n---\nevent_time: \"2025-12-31\"\n---\nTwo\n---\ntime: \"soon\"\n---\nThree\n---\ntags: [q]\n---\nFour\n---\ntime: 2026-05-05\n---\nevent_time: partial\ntime: 2026-05-06T10:00\n---\nFive"
    files = spark.createDataFrame([("a.md", bytearray(raw.encode())), ("b.md", bytearray(b""))], "path string, content binary")
    rows = vault.legacy_blocks(files).orderBy("path", "pos").collect()
    assert [(r.bad, r.date, r.time, r.mood, r.tags, r.text.strip()) for r in rows] == [
        (False, "2026-01-02", "08:30", "ok", ["a", "b"], "One\n---\nnot a block"), (True, None, None, "x", [], ""), (False, "2025-12-31", "00:00", None, [], "Two"),
        (False, None, None, None, [], "Three"), (True, None, None, None, ["q"], "Four"), (True, "2026-05-05", "00:00", None, [], ""), (False, "2026-05-06", "10:00", None, [], "Five"),
    ]
    assert rows[0].hash == __import__("hashlib").sha256(b"One\n---\nnot a block").hexdigest()[:16]


@pytest.fixture
def small(spark, tmp_path):
    root = str(tmp_path / "vault")
    writers.init_vault(root)
    for i in range(5):
        writers.remember(root, f"Walk {i} by the river with [[An]] and [[Bình]] #walks", TODAY, "07:00", day=f"2026-06-0{i + 1}", mood=f"calm/{5 - i}", relations={"joy": ["Running"]} if i else None)
    writers.remember(root, "Dinner about the budget", TODAY, "19:00", day="2026-06-03", checkin="sleep_hours=7")
    return root


def same_tables(a: Diary, b: Diary) -> None:
    for t in ("entries", "links", "tags", "relations", "entities", "daily_meta", "superseded", "files"):
        x, y = getattr(a, t), getattr(b, t)
        cols = [c for c in y.columns if c != "extra"]
        assert sorted(map(str, x.select(*cols).collect())) == sorted(map(str, y.select(*cols).collect())), t


def test_vault_round_trip(spark, small, tmp_path):
    index = str(tmp_path / "index")
    counts = vault.rebuild(spark, small, index)
    assert (counts["entries"], counts["entities"], counts["daily_meta"], counts["links"], counts["skipped"]) == (6, 3, 5, 10, [])
    d = vault.open_index(spark, index)
    stored = search.build_index(spark, d.entries, str(tmp_path / "postings"))
    best = search.recall(d, stored, "river walk").collect()
    assert best[0].id == "2026-06-05#0" and best[0].links == ["An", "Bình"] and best[0].relations == {"joy": ["Running"]} and best[0].tags == ["walks"] and best[0].mood == "calm"
    assert search.recall(d, stored, "zebra").count() == 0
    assert {r.id for r in search.recall(d, stored, entity="Running", relation="joy").collect()} == {f"2026-06-0{i}#0" for i in (2, 3, 4, 5)}
    report = analysis.reflect(d, "2026-06-01", "2026-06-30")
    assert [r.kind for r in report["insight_candidates"].orderBy("part").collect()] == ["mood_streak", "co_occurrence"]
    assert {r.id for r in report["entries_without_links"].collect()} == {"2026-06-03#1"}
    assert [r.concept for r in report["concept_bridges"].collect()] == ["walks"] and report["suggested_actions"].count() > 2
    text_ = writers.render_report(report, "2026-06-01", "2026-06-30")
    assert text_.startswith("# Reflect — 2026-06-01 → 2026-06-30\n") and "- distribution: calm×5" in text_ and "- **mood_streak** — Intensity declined 5 days" in text_ and "- [ ] add `[[walks]]` to 5 entries (2026-06-01#0, " in text_ and "- brings joy: [[Running]]×4" in text_
    assert vault.file_of(spark, small, "journal/2026/06/2026-06-02.md").count() == 1 and vault.file_of(spark, small, "journal/none.md").count() == 0 == vault.file_of(spark, small, "other/x.md").count()


def test_sync_equals_a_rebuild(spark, small, tmp_path):
    """After edits, removals, files of one date that come and go, and entities; and of another version."""
    index, day = str(tmp_path / "index"), tmp_path / "vault/journal/2026/06"
    same_tables(vault.current_index(spark, small, index), vault.read_vault(spark, small))
    assert vault.sync(spark, small, index) == {"added": 0, "changed": 0, "removed": 0, "scanned": 8, "skipped": []}
    assert writers.forget(small, ["2026-06-01#0"], redact=True) == 1 and writers.merge_entities(small, "Bình", "An") == 4
    assert "[redacted 2026-06-01]" in (day / "2026-06-01.md").read_text()
    (day / "2026-06-02.md").unlink()
    assert {k: v for k, v in vault.sync(spark, small, index).items() if k in ("added", "changed", "removed")} == {"added": 0, "changed": 5, "removed": 2}
    same_tables(vault.open_index(spark, index), vault.read_vault(spark, small))
    (day / "z").mkdir()
    (day / "z/2026-06-03.md").write_text("# x\n\n## 01:00\nother [[An]]\n")
    (day / "_2026-07-09.md").write_text("# x\n\n## 01:00\nhidden\n")
    (day / ".2026-07-10.md").write_text("# x\n\n## 01:00\ndot\n")
    got = vault.sync(spark, small, index)
    assert got["added"] == 2 and got["skipped"] == ["journal/2026/06/z/2026-06-03.md"]
    d = vault.open_index(spark, index)
    same_tables(d, vault.read_vault(spark, small))
    assert d.entries.where("body = 'hidden'").count() == 1 and d.entries.groupBy("id").count().where("count > 1").count() == 0
    (day / "2026-06-03.md").unlink()
    assert vault.sync(spark, small, index)["skipped"] == []
    d = vault.open_index(spark, index)
    same_tables(d, vault.read_vault(spark, small))
    assert d.entries.where("id = '2026-06-03#0'").first().body == "other [[An]]"
    (day / "_2026-07-09.md").unlink()
    vault.sync(spark, small, index)
    same_tables(vault.open_index(spark, index), vault.read_vault(spark, small))
    spark.createDataFrame([(1,)], "version int").write.mode("overwrite").json(f"{index}/version")
    assert vault.index_version(spark, index) == 1 and vault.index_version(spark, str(tmp_path / "none")) is None
    same_tables(vault.current_index(spark, small, index), vault.read_vault(spark, small))
    assert vault.index_version(spark, index) == vault.INDEX_VERSION


def test_notes_are_only_appended_to(tmp_path):
    root = str(tmp_path / "v")
    writers.init_vault(root)
    path = writers.note_path(root, "journal", "2026-06-01")
    path.parent.mkdir(parents=True)
    path.write_bytes(b"# t\r\n\r\n## 07:00\r\nbody  \r\n\r\n\r\n")
    was = path.read_bytes()
    assert writers.append_entry(root, "2026-06-01", "08:00", "\n\n  next\n\n") == "2026-06-01#1"
    assert path.read_bytes() == was + b"\n## 08:00\n  next\n"
    assert writers.vault_state(root) == "current" and writers.vault_state(str(tmp_path)) == "unversioned"


def test_analysis_of_spellings_majorities_and_verbs(spark):
    """Relations by folded target, tags that most entries link already, a type's verbs, spikes with evidence."""
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    days = [f"2026-06-{i:02d}" for i in range(1, 9)]
    entries = t([(f"{d}#0", "f", d, "08:00", 0, "calm", 3, "x") for d in days], "id string, file string, date string, time string, ordinal int, mood string, intensity int, body string")
    tag = [(f"{days[i]}#0", 0, w, w.lower()) for i, w in enumerate(["Gym", "gym", "gym", "GYM"])] + [(f"{days[i]}#0", 1, "work", "work") for i in range(4)]
    links = [(f"{days[i]}#0", 0, "Work", "work") for i in range(3)] + [(f"{days[i]}#0", 1, "Gym", "gym") for i in range(2)]
    rel = [(f"{days[0]}#0", v, n, n.lower()) for v, n in (("joy", "Lan"), ("joy", "LAN"), ("with", "lan"), ("near", "Lan"))] + [(f"{days[1]}#0", "joy", "LAN", "lan"), (f"{days[2]}#0", "near", "Hue", "hue")]
    entities = t([("Lan", "lan", "a", "unknown", []), ("Hue", "hue", "b", "unknown", [])], "name string, name_key string, file string, type string, aliases array<string>")
    keyed = "entry_id string, pos int, {0} string, {0}_key string"
    d = Diary(entries, t(links, keyed.format("target")), t(rel, "entry_id string, rel_type string, target string, target_key string"), t(tag, keyed.format("tag")), entities, t([], "date string, sleep_hours double, exercise string, mood_score double"), t([], "entry_id string, newer_id string"))
    assert [(r.concept, r.entry_count, r.evidence) for r in analysis.concept_bridges(d, days[0], days[-1]).collect()] == [("gym", 4, [f"{x}#0" for x in days[:4]])]
    assert [(r.target, r.n) for r in analysis.relation_summary(d, days[0], days[-1]).collect()] == [("LAN", 3)]
    assert [(r.name, r.verbs, r.reason[:20]) for r in analysis.type_suggestions(d).collect()] == [("Lan", ["joy", "near", "with"], 'Target of a "joy::" ')]
    assert {r.id[:10] for r in analysis.moods_without_relation(d).collect()} == set(days[2:])
    assert {r.id[:10] for r in analysis.tagged_without_links(d).collect()} == {days[3]}


def test_alias_candidates_equal_all_pairs(spark):
    """Against every pair of names, by the plain definitions."""
    import itertools
    import random

    rng = random.Random(4)
    names = ["Anh Hùng", "hung", "Hùng Anh Tú", "Bình", "Binh", "bạn Bình", "Q", "", "  ", "Zoë Q", "martha", "marhta", "dwayne", "duane", "dixon", "dicksonx", "x.*y", "x.*z"]
    names += ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    names = sorted(set(names))
    want = {}
    for a, b in itertools.combinations(names, 2):
        x, y = text.fold_text(a), text.fold_text(b)
        sim, within = similarity.jaro_winkler(x, y), similarity.contained(a, b)
        if sim >= 0.85 - 1e-12 or within:
            sim = int(sim * 1000 + 0.5) / 1000
            want[a, b] = max(0.9, sim) if within else sim
    rows = analysis.alias_candidates(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {(r.a, r.b): r.similarity for r in rows} == pytest.approx(want)
    assert [r.similarity for r in rows] == sorted((r.similarity for r in rows), reverse=True)


def test_watch_reports_changes(spark, small, tmp_path):
    import threading

    index, seen, done = str(tmp_path / "index"), [], threading.Event()
    vault.rebuild(spark, small, index)

    def on_change(diff, number):
        seen.append(sorted((r.path, r.change) for r in diff.collect()))
        vault.sync(spark, small, index)
        done.set()

    query = watch(spark, small, f"{index}/files", on_change, str(tmp_path / "watch"), seconds=1)
    try:
        writers.append_entry(small, "2026-06-09", "07:00", "new")
        assert done.wait(60)
        assert seen[0] == [("journal/2026/06/2026-06-09.md", "added")]
    finally:
        query.stop()
    assert vault.open_index(spark, index).entries.where("id = '2026-06-09#0'").count() == 1


def test_commands(spark, tmp_path):
    root, said = str(tmp_path / "v"), []
    run = lambda *argv: (said.clear(), cli.main(["--vault", root, *argv], spark, said.append), json.loads(said[-1]))[1:]
    assert run("recall", "x")[0] == 1 and run("init") == (0, {"ok": True, "data": {"vault": root, "state": "current"}})
    code, out = run("remember", "Met [[An]] at the river", "--mood", "happy/4", "--relation", "joy=An,Bo", "--date", "2026-06-01", "--time", "07:00", "--checkin", "sleep_hours=7")
    assert code == 0 and out["data"]["id"] == "2026-06-01#0" and out["data"]["stubs"] == ["An", "Bo"]
    assert run("remember", "x", "--mood", "so so")[0] == 1
    found = run("recall", "river met")[1]["data"]
    assert found["count"] == 1 and found["results"][0]["links"] == ["An"] and found["results"][0]["relations"] == {"joy": ["An", "Bo"]}
    assert [e["name"] for e in run("recall", "--entity", "an")[1]["data"]["entity_context"]] == ["An"]
    assert run("recall", "--since", "soon")[0] == 1
    assert {e["name"]: e["mentions"] for e in run("entities")[1]["data"]["entities"]} == {"An": 1, "Bo": 0}
    assert run("recall", "--digest", "--from", "2026-06-01", "--to", "2026-06-02")[1]["data"]["days_logged"] == 1
    assert run("reflect", "--since", "2026-05-01", "--md")[1]["data"]["md_path"].endswith(".md")
    assert run("merge", "Bo", "An")[1]["data"]["links_rewritten"] == 1
    assert run("forget", "--entity", "AN", "--dry-run")[1]["data"]["forgotten"] == 1 and run("forget", "2026-06-01#0", "--redact")[1]["data"]["forgotten"] == 1
    assert run("reindex")[1]["data"]["entries"] == 1
    assert cli.resolve_vault(None, {"DAYBOOK_VAULT": "e"}, {"vault": "c"}) == "e" and cli.resolve_vault("f", {"DAYBOOK_VAULT": "e"}) == "f" and cli.resolve_vault(None, {}, {"vault": "c"}) == "c"
    assert cli.read_config(str(tmp_path / "none.json")) == {}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, **held):
            self.conf = {k.replace("_", "."): v for k, v in held.items()}

    assert storage.shared_dir(Session(spark_checkpoint_dir="s3a://b/c/")) == "s3a://b/c"
    assert storage.shared_dir(Session(spark_master="local[8]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            storage.shared_dir(Session(spark_master=master))


def test_forget_by_entity(spark, tmp_path):
    from datetime import date

    root = str(tmp_path / "v")
    writers.init_vault(root)
    for day, hour, body in ((1, "07:00", "a [[Hùng]] b [[hung]]"), (1, "08:00", "c [[Bình]]"), (1, "09:00", "d [[HÙNG|H]]"), (2, "07:00", "e [[Hùng]]"), (2, "08:00", "f [[Hùng Anh]]")):
        writers.remember(root, body, date(2026, 6, day), hour)
    assert vault.forget_entity(spark, root, "Hung", dry_run=True) == 3 and vault.read_vault(spark, root).entries.count() == 5
    assert vault.forget_entity(spark, root, "Hung") == 3
    assert sorted(r.body.strip()[0] for r in vault.read_vault(spark, root).entries.collect()) == ["c", "f"]
    assert vault.forget_entity(spark, root, "Hung") == 0


def test_import_is_idempotent(spark, tmp_path):
    (tmp_path / "old/deep").mkdir(parents=True)
    (tmp_path / "old/a.md").write_text("# d\n---\ntime: \"2026-01-02T08:30:00Z\"\ntags: ['x', 'y z']\n---\nOne\n---\ntime: \"2026-01-03T08:30:00Z\"\n---\nOne\n---\nmood: x\n---\nNo date")
    (tmp_path / "old/deep/b.md").write_text("---\ntime: \"2026-01-02T09:30:00Z\"\nmood: calm\n---\nTwo\n---\ntime: \"2026-01-02T09:30:00Z\"\n---\n")
    (tmp_path / "old/README.md").write_text("# Nothing here\n")
    root = str(tmp_path / "v")
    writers.init_vault(root)
    dry = vault.import_folder(spark, str(tmp_path / "old"), root, dry_run=True)
    assert vault.read_vault(spark, root).entries.count() == 0
    first = vault.import_folder(spark, str(tmp_path / "old"), root)
    assert first == {**dry, "dry_run": False} == {"dry_run": False, "files": 3, "blocks": 4, "entries_created": 2, "skipped_duplicate": 1, "skipped_bad": 2}
    d = vault.read_vault(spark, root)
    assert sorted((r.id, r.time, r.mood, r.body) for r in d.entries.collect()) == [("2026-01-02#0", "08:30", None, "One"), ("2026-01-02#1", "09:30", "calm", "Two")]
    assert sorted(r.tag for r in d.tags.collect()) == ["x", "y z"]
    again = vault.import_folder(spark, str(tmp_path / "old"), root)
    assert (again["entries_created"], again["skipped_duplicate"]) == (0, 3)
    (tmp_path / "v/.index/import-log.json").write_text("{broken")
    assert writers.read_import_log(root) == set()
