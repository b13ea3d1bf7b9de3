"""What a plan may move or hold as its tables grow, and results where the cheaper plan could differ."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from daybook.operators import analysis, claims, search
from daybook.operators.tables import SCHEMAS, Diary


def plan_of(df):
    """The physical plan before it runs, a line for each operator."""
    return df._jdf.queryExecution().executedPlan().toString()


def small_diary(spark, entries, links, typed, old=()):
    """Entries as (id, date), links as (entry, place, target), entities as (name, type)."""
    rows = {
        "entries": [(i, "", d, "08:00", 0, None, None, "") for i, d in entries], "links": [(*x, x[2].lower()) for x in links],
        "entities": [(n, n.lower(), "", t, []) for n, t in typed], "superseded": list(old), "relations": [], "tags": [], "daily_meta": [],
    }
    return Diary(**{t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in rows.items()})


def test_superseded_pairs_are_judged_where_they_meet(spark):
    """Shared links in several places and spellings give a pair once, with its first one; no pair is shuffled."""
    entries = [("1", "2024-01-01"), ("2", "2024-02-01"), ("3", "2024-03-01"), ("4", "2024-03-02"), ("5", "2024-01-01")]
    links = [("1", 0, "acme"), ("1", 1, "ANN"), ("1", 2, "ann"), ("1", 3, "Bob"), ("2", 0, "Bob"), ("2", 1, "Ann"), ("2", 2, "Zeta"), ("2", 3, "Bolt"), ("3", 0, "Ann"), ("3", 1, "Acme"), ("4", 0, "Ann"), ("4", 1, "Chef"), ("5", 0, "Acme"), ("5", 1, "Ann")]
    typed = [("Acme", "employer"), ("Zeta", "Job"), ("Bolt", "employer"), ("Chef", "job")]
    found = analysis.superseded_candidates(small_diary(spark, entries, links, typed, [("5", "2")]), "2024-01-01", "2024-12-31", limit=None)
    assert sorted(map(tuple, found.collect())) == [
        ("1", "2", "employer", "Acme", "Bolt", "ANN"), ("2", "3", "employer", "Bolt", "Acme", "Ann"), ("2", "4", "job", "Zeta", "Chef", "Ann"),
    ]
    plan = plan_of(found)
    assert re.search("Join", plan).start() < re.search("Exchange|Aggregate|Sort ", plan).start()


def test_postings_leave_their_entry_behind(spark):
    """A posting is whole before it becomes a row: else each copies its entry's tokens, the square of its length."""
    docs = spark.createDataFrame([("1", "b a b, C b a"), ("2", "")], "id string, body string")
    rows = search.postings(docs)
    kept = re.search(r"Generate explode\(.*?\), \[([^\]]*)\]", plan_of(rows)).group(1)
    assert sorted(re.sub(r"#\d+", "", kept).split(", ")) == ["entry_id", "len"]
    assert sorted(map(tuple, rows.drop("bucket").collect())) == [("a", "1", 2, 6, [1, 5]), ("b", "1", 3, 6, [0, 2, 4]), ("c", "1", 1, 6, [3])]


def test_a_large_bucket_is_written_by_as_many_tasks_as_it_fills(spark, tmp_path):
    """No fixed number of tasks: a bucket was dealt to eight at most before, however large."""
    docs = spark.range(40000, numPartitions=32).select(F.col("id").cast("string").alias("id"), F.lit("same words for all").alias("body"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        search.build_index(spark, docs, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = {b.name: len(list(b.glob("*.parquet"))) for b in (tmp_path / "postings").glob("bucket=*")}
    assert len(files) == 4 and min(files.values()) > 8


def test_pairs_of_targets_come_from_their_entry(spark):
    """One join (links with entries), not one of an entry's links with each other; repeated links count once."""
    links = [("1", 0, "b"), ("1", 1, "a"), ("1", 2, "b"), ("1", 3, "c"), ("2", 0, "a"), ("2", 1, "b"), ("3", 0, "a"), ("3", 1, "c")]
    d = small_diary(spark, [("1", "2024-01-01"), ("2", "2024-01-02"), ("3", "2023-01-01")], links, [])
    found = analysis.pair_evidence(d, "2024-01-01", "2024-12-31", least=1)
    assert sorted(map(tuple, found.collect())) == [("a", "b", 2, "1"), ("a", "b", 2, "2"), ("a", "c", 1, "1"), ("b", "c", 1, "1")]
    assert len(re.findall("Join", plan_of(analysis.target_pairs(d, least=1)))) == 1


def test_every_page_goes_through_the_suffix_array():
    """A page whose markup is plain is left to finish_page like the others, with the same text."""
    import pandas as pd

    from daybook.llm import html_extract

    page = "<html><body><nav>home</nav><article><p>one two</p><p>three</p></article><div>loose</div></body></html>"
    rows = pd.DataFrame({"rid": [0], "page_id": [1], "url": ["http://a.b/c"], "page": [5], "html": [page]})
    (out,) = html_extract.parse_batches(iter([rows]))
    assert "text" not in out and list(out["places"][0]) == ["junk", "article", "article", "loose"] and out["stream"][0] == ["home", "loose"]
    assert html_extract.finish_page(list(zip(out["places"][0], out["texts"][0], strict=True)), [1], 1) == "one two three"


def test_notes_are_parsed_in_portions_of_bytes(monkeypatch):
    """A batch is cut by the size of its notes, so what a worker holds parsed doesn't grow with the batch."""
    import pandas as pd

    from daybook.sources import vault

    rows = pd.DataFrame({"path": [f"journal/d{i}.md" for i in range(6)], "kind": "journal", "content": [b"## 10:00\nabc", b"", b"x" * 99, b"## 11:00\nq", b"## 12:00\nr", b""]})
    (whole,) = vault._parse(iter([rows]))
    monkeypatch.setattr(vault, "PARSE_BYTES", 24)
    parts = list(vault._parse(iter([rows])))
    assert [len(p) for p in parts] == [2, 1, 3] and pd.concat(parts, ignore_index=True).equals(whole)
    assert [len(p) for p in vault._parse(iter([rows.iloc[:0]]))] == [0]


def test_page_texts_move_packed(spark):
    """Parsed pages are shuffled as compressed packs and stored once; plain text was shuffled and its tokens stored too."""
    from daybook.llm import html_extract

    html = "<html><body><nav>home one two</nav><article><p>word " + "other words " * 40 + "</p></article></body></html>"
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.lit(html).alias("html"))
    done = html_extract.extract(spark, pages)
    exchanged = re.findall(r"Exchange hashpartitioning\(([a-z]+)#", plan_of(done))
    assert "pack" in exchanged and "rid" not in exchanged
    assert {r.text for r in done.collect()} == {"word " + ("other words " * 40).strip()} and done.count() == 100


def test_bridges_and_insights_read_what_is_written_once(spark):
    """Tags in range are made once for all parts of the bridges' plan, links once for all kinds of insights."""
    entries = [(str(i), f"2024-01-0{i}") for i in range(1, 6)] + [("9", "2020-01-01")]
    d = small_diary(spark, entries, [("1", 0, "a"), ("1", 1, "b"), ("2", 0, "sky"), ("9", 0, "a")], [("a", "x")])
    tags = [(str(i), 0, t, t.lower()) for i in range(1, 4) for t in ("Sky", "a")] + [("4", 0, "SKY", "sky"), ("9", 0, "sky", "sky")]
    d = replace(d, tags=spark.createDataFrame(tags, SCHEMAS["tags"]))
    found = analysis.concept_bridges(d, "2024-01-01", "2024-12-31")
    assert "/bridges-" in plan_of(found) and [tuple(r) for r in found.collect()] == [("Sky", 4, ["1", "2", "3", "4"])]
    told = analysis.insights(d, "2024-01-01", "2024-12-31")
    assert len(re.findall("LocalTableScan.*target", plan_of(told))) == 0 and "/links-" in plan_of(told)


def test_mentions_are_reduced_to_their_spellings(spark):
    """Claims of each spelling's least place are those of all mentions."""
    rows = spark.createDataFrame([("B", "3"), ("b", "2"), ("B", "1"), ("b", "4"), ("c", "7"), (None, "1")], "target string, place string")
    known, least = spark.createDataFrame([("c",)], "name_key string"), claims.least_places(rows)
    assert least.count() == 4 and [tuple(r) for r in claims.new_names(least, known).collect()] == [tuple(r) for r in claims.new_names(rows, known).collect()] == [("B", "b")]


def test_actions_read_tables_that_are_written_once(spark):
    """Links come with their dates, once; broken ones and loose tags are spellings before they are joined. Null tags and links without an entry count as before."""
    d = small_diary(spark, [("1", "2024-01-01"), ("2", "2024-01-02"), ("3", "2020-01-01")], [("1", 0, "a"), ("1", 1, "B"), ("9", 0, "b"), ("9", 1, "c")], [("a", "x"), ("u", "unknown")])
    tags = [("1", 0, "Sky", "sky"), ("2", 0, "sky", "sky"), ("3", 0, "a", "a"), ("3", 1, None, None)]
    d = replace(d, tags=spark.createDataFrame(tags, SCHEMAS["tags"]), relations=spark.createDataFrame([("1", "joy", "U", "u")], SCHEMAS["relations"]))
    found = analysis.suggested_actions(d, "2024-01-01", "2024-12-31")
    assert not re.search("LocalTableScan.*(target|tag|name)", plan_of(found))
    assert sorted(map(tuple, found.collect())) == [
        (1, "classify 1 unknown-type entities"), (3, "fix 3 broken wikilinks"), (4, "backfill links on 2 entries"), (6, "convert 2 tags to wikilinks/relations"), (9, "set type of 1 unknown-type entities"),
    ]
    plan = plan_of(analysis.broken_links(d))
    assert "partial_min" in plan[re.search("Join", plan).start() :]
    assert [tuple(r) for r in analysis.links_in_range(analysis.with_dated_links(d), "2024-01-01").select("entry_id", "target", "date").orderBy("target").collect()] == [("1", "B", "2024-01-01"), ("1", "a", "2024-01-01")]


def test_patterns_are_tried_on_lines_with_two_colons_only(spark):
    """Other lines of a section are not trimmed for each pattern; blank ones are told without trimming. White space of all kinds is as before."""
    from daybook.sources import notes as plain
    from daybook.sources import sections

    body = "　\n## 08:30\n \n tags:: a, b \n  mood:: ok/2\n x y #c/d e#f \n　\n##  9:05\r\n\nmood:: z\r\n #g\n"
    found = sections.sections(spark.createDataFrame([("1", body)], "note string, body string"))
    assert re.search(r"Contains\(lambda x[^,]*, ::\)", plan_of(found))
    want = [(e["time"], e["mood"], e["intensity"], e["tags"]) for e in plain.parse_entries(body)]
    assert [(r.time, r.mood, r.intensity, r.tags) for r in found.orderBy("ordinal").collect()] == want and len(want) == 2


def test_notes_are_parsed_once_for_all_tables(spark):
    """What files say is written; the plans of the tables parse nothing. Missing and nested values are as the parser gives them."""
    from daybook.sources import vault

    content = ["---\nsleep_hours: 7.5\nmood_score: x\nother: y\n---\n## 10:00\nmood:: ok/2\nwith:: [[Ann]], [[Bob]]\n`[`[a]] #t\n\n## 11:00\n", "", "---\ntype: thing\naliases: [q]\n---\n"]
    files = [(p, i, k, c.encode()) for i, (p, k, c) in enumerate(zip(["journal/d1.md", "journal/d2.md", "entities/e.md"], ["journal", "journal", "entity"], content, strict=True))]
    d = vault.tables(spark.createDataFrame(files, "path string, mtime bigint, kind string, content binary"))
    assert not any("MapIn" in plan_of(t) for t in (d.entries, d.links, d.tags, d.relations, d.superseded, d.daily_meta, d.entities))
    rows = lambda t, *c: sorted(map(tuple, t.select(*c).collect()), key=str)
    assert rows(d.entries, "id", "mood", "intensity", "body") == [("d1#0", "ok", 2, "`[`[a]] #t"), ("d1#1", None, None, "")]
    assert rows(d.relations, "entry_id", "rel_type", "target") == [("d1#0", "with", "Ann"), ("d1#0", "with", "Bob")] and rows(d.tags, "tag") == [("t",)] and d.links.count() == 0
    assert rows(d.daily_meta, "date", "sleep_hours", "mood_score", "extra") == [("d1", 7.5, None, {"other": "y"}), ("d2", None, None, None)]
    assert rows(d.entities, "name", "type", "aliases") == [("e", "thing", ["q"])]


def test_recall_takes_the_best_entries_rows_where_tables_are_read(spark, sf, monkeypatch):
    """The ids of the best entries reach the lines before these are grouped; where there are too many to list, joins give the same rows."""
    from daybook.plans import views

    d, index = views.diary(spark, sf), views.index_of(spark, sf, "entries")
    ask = lambda: search.recall(d, index, query="now 4-not specified p", entity="s7").drop("relations")
    narrow = ask()
    assert len(re.findall(r"cast\(l_orderkey#\d+L? as string\) IN", plan_of(narrow))) >= 3
    rows = [tuple(r) for r in narrow.collect()]
    monkeypatch.setattr(search, "LISTED", 0)
    assert rows and [tuple(r) for r in ask().collect()] == rows


def test_alias_pairs_are_counted_as_listed(spark):
    """Against every pair by the plain definitions: numbers of one and of many lengths, stems that are alike, hold digits, are empty or contained."""
    import itertools
    import random

    from daybook.functions import similarity, text

    rng = random.Random(11)
    draw = lambda stem, n, least, most: {stem + "".join(rng.choice("0123456789") for _ in range(rng.randint(least, most))) for _ in range(n)}
    names = {"Supplier", "supplier#", "room", "Room 7", "old room 7", "Zoë", "zoe", "7", "", "x9 room", "Romo 12", "Supplies#00012", "r\n5"}
    names |= draw("Room ", 60, 1, 4) | draw("room ", 30, 2, 2) | draw("Moor ", 30, 1, 3) | draw("Customer#0", 60, 8, 8) | draw("Supplier#0", 40, 8, 8) | draw("x9 ", 40, 1, 9) | draw("", 60, 1, 6) | draw("ab", 60, 5, 7) | draw("Customer", 40, 2, 3)
    want = 0
    for a, b in itertools.combinations(sorted(names), 2):
        want += similarity.jaro_winkler(text.fold_text(a), text.fold_text(b)) >= 0.85 or similarity.contained(a, b)
    entities = spark.createDataFrame([(n,) for n in [*names, "Room 7"]], "name string")
    assert [analysis.alias_count(entities, crowd=n).first().n for n in (20, 10**6)] == [want, want]


def test_actions_take_all_entities(spark, sf):
    """Suppliers, of unknown type and numbered, and customers are among the actions' entities."""
    from daybook.plans.catalogue import QUERIES

    found = {r.priority: r.action for r in QUERIES["l3_suggested_actions"](spark, sf).where("priority < 10").collect()}
    assert found[1] == "classify 10 unknown-type entities" and found[2].startswith("review ") and int(found[2].split()[1]) > 150 * 149 / 2 and found[9] == "set type of 10 unknown-type entities"


def test_numbered_names_of_a_crowd_are_not_paired(spark):
    """Classes are paired, not names: of 20,000 names as they are numbered in the tables all pairs are counted."""
    names = spark.range(20000).select(F.format_string("Customer#%09d", "id").alias("name"))
    assert analysis.alias_count(names).first().n == 20000 * 19999 // 2
