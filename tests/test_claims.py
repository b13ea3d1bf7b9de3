"""Claimed names and merged check-ins against plain readings, repeated batches and odd rows."""

import json
import random

from pyspark.sql import functions as F

from daybook.functions.text import fold_text
from daybook.operators import checkins, claims


def test_names_are_claimed_once_and_the_first_spelling_stays(spark, tmp_path):
    draw, path = random.Random(3), f"file://{tmp_path}/stubs"
    spellings = ["Công Ty", "cong ty", "CÔNG TY", "An", "an", "Bo", "bo ", "Đà Lạt", "da lat", "Known", "KNOWN", "Alias", "alias", "", "  ", None]
    entities = spark.createDataFrame([("known", ["ALIAS", "x"]), ("other", None)], "name string, aliases array<string>")
    taken, batches = {"known", "alias", "x", "other"}, {}
    for k in range(3):
        rows = [(draw.choice(spellings), draw.randrange(5)) for _ in range(8)]
        want = {}
        for t, p in sorted((r for r in rows if r[0] and r[0].strip()), key=lambda r: (r[1], r[0])):
            if fold_text(t) not in taken:
                want.setdefault(fold_text(t), t)
        batches[k] = (spark.createDataFrame(rows, "target string, place int"), want)
        for _ in range(2):  # a repeated batch is written over
            got = claims.claim_names(spark, batches[k][0], entities, path, f"b{k}")
            assert {r.name_key: r.name for r in got.collect()} == want
        taken |= set(want)
    assert sorted(r.name_key for r in claims.read_stubs(spark, path).collect()) == sorted(taken - {"known", "alias", "x", "other"})


def test_checkin_fields_merge_by_key_and_keep_their_types(spark):
    draw, rows = random.Random(5), []
    values = [1, 2.5, "a", "ü\"x", None, True, [1, 2], {"a": 1}]
    for i in range(300):
        told = {draw.choice(["sleep", "mood", "k\"q", "extra"]): draw.choice(values) for _ in range(draw.randrange(3))}
        rows.append((draw.choice("abc"), i, json.dumps(told) if draw.random() < 0.8 else draw.choice([None, "{", "[1]", "3", "", "null"])))
    want = {}
    for day, _, text in rows:
        try:
            told = json.loads(text or "")
        except ValueError:
            continue
        if isinstance(told, dict):
            for k, v in told.items():
                want[day, k] = v
    merged = checkins.merged_fields(spark.createDataFrame(rows, "day string, at int, fields string"), "day", "at", "fields")
    got = {(r.day, r.key): json.loads(r.v) for r in merged.select("day", "key", F.to_json("value").alias("v")).collect()}
    assert got == want and len(want) == 12
    whole = {r.day: json.loads(r.f) for r in checkins.as_objects(merged, "day").select("day", F.to_json("fields").alias("f")).collect()}
    assert whole == {d: {k: v for (e, k), v in want.items() if e == d} for d in "abc"}
