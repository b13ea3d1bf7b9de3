"""Sections in the JVM equal the plain parser; forgetting equals it byte for byte, in notes and as rows."""

import random

from daybook.sources import notes as plain
from daybook.sources import sections as sec
from daybook.sources import writers
from daybook.operators.running import running_sum

LINES = ["## 08:30", "##  9:05 ", "## 8:3", "# 08:30", "", "", "  ", "mood:: vui/4", "mood:: calm", "mood:: x/9", "mood:: a b", "superseded:: 2024-01-02#3", "superseded:: [[An]]", "superseded:: soon", "tags:: a, b ,", "tags:: ,", "tags:: [[x]]",
         "with:: [[An]], [[Công ty|firm]]", "WITH:: [[Chi]]", "joy:: [[An]] and", "eases:: [[ ]]", "plain text #tag1 [[Link|x]]", "`[[code]]` #đọc/sách a#b", "```", "[[An]] #tag1", "text\r", "##08:30", " ## 07:00", "- item ::"]


def bodies(n, seed):
    draw = random.Random(seed)
    section = lambda: ["", "## 08:30", *draw.choices(LINES[4:25], k=draw.randrange(8)), *draw.choices(LINES, k=draw.randrange(4))]
    return ["\n".join(x for _ in range(draw.randrange(5)) for x in section()) for _ in range(n)] + ["", "## 08:30", "\n## 08:30\n\n\nx\n\n\n## 09:00", "no heading", "a\r\n\r\n## 08:30\r\nmood:: ok/1\r\ntext\r\n\r\n"]


def test_sections_equal_the_plain_parser(spark):
    rows = [(f"n{i}", b) for i, b in enumerate(bodies(300, 1))] + [("null", None)]
    got = {}
    for r in sec.sections(spark.createDataFrame(rows, "note string, body string")).collect():
        got[r.note, r.ordinal] = {"time": r.time, "ordinal": r.ordinal, "text": r.text, "links": r.links, "mood": r.mood, "intensity": r.intensity, "superseded": r.superseded, "tags": r.tags, "relations": r.relations}
    want = {(n, e["ordinal"]): e for n, b in rows if b is not None for e in plain.parse_entries(b)}
    assert len(want) > 500 and got.keys() == want.keys()
    for key in want:
        assert got[key] == want[key], (key, dict(rows)[key[0]])


def test_forgetting_in_notes_equals_the_writer(spark, tmp_path):
    draw = random.Random(4)
    days = [(f"2024-01-{i + 1:02d}", b) for i, b in enumerate(bodies(25, 2))]
    doomed = [(d, o) for d, b in days for o in range(6) if draw.random() < 0.4]
    for redact in (False, True):
        root = tmp_path / str(redact)
        (root / "journal").mkdir(parents=True)
        for d, b in days:
            writers.write_file(writers.note_path(str(root), "journal", d), b)
        writers.forget(str(root), [f"{d}#{o}" for d, o in doomed], redact)
        want = {d: writers.read_file(writers.note_path(str(root), "journal", d)) for d in {d for d, _ in doomed}}
        got = sec.forget_in_notes(spark.createDataFrame(days, "note string, body string"), spark.createDataFrame(doomed, "note string, ordinal int"), redact)
        assert {r.note: r.body for r in got.collect()} == want


def test_forgotten_rows_move_up_and_references_follow(spark):
    draw = random.Random(6)
    rows = [(f"n{n}", o, f"t{o}", draw.choice([None, *range(size + 2)])) for n, size in enumerate([0, 1, 5, 400]) for o in range(size)]
    doomed = {(n, o) for n, o, _, _ in rows if draw.random() < 0.4} | {("n9", 0)}
    now = {}
    for n, o, _, _ in rows:
        if (n, o) not in doomed:
            now[n, o] = sum(1 for m, _ in now if m == n)
    want = sorted((n, now[n, o], t, now.get((n, r))) for n, o, t, r in rows if (n, o) in now)
    got = sec.forget_rows(spark.createDataFrame(rows, "note string, ordinal int, text string, newer int"), spark.createDataFrame(sorted(doomed) * 2, "note string, ordinal int"), "newer")
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["note", "ordinal", "text", "newer"]


def test_running_sums_split_a_group_among_parts(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id % 2 = 0 or id > 2000 as hot", "id as o", "id % 3 as v")
    got = {(r.hot, r.o): r.s for r in running_sum(rows, ["hot"], ["o"], "v", "s").collect()}
    total = {}
    for o in range(5000):
        hot = o % 2 == 0 or o > 2000
        total[hot] = total.get(hot, 0) + o % 3
        assert got[hot, o] == total[hot]
