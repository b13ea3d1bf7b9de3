"""Token counts against the library, over whole texts, chunks of any size, and full tables of states."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from daybook.llm import token_counts as tc
from daybook.llm.queries import QUERIES, table
from daybook.llm.tokens import vocabulary_path

PATH = vocabulary_path(tc.VOCABULARY)
SPECIAL = "<|endoftext|>"
ODD = ["", "it's we'll  don't''s 're x's\n\n  a \t b  ", f"{SPECIAL}a {SPECIAL}{SPECIAL} b's{SPECIAL}", f"a{SPECIAL[:-1]} {SPECIAL[1:]}", "é́ 日本語  x  y ½ ² Ⅷ", "   ", "\n", "'", " '", "a  'll", "''re'llx", " 　  \u0085  x", "x" * 500 + "-" * 300 + " " * 200, "😀😀 👨‍👩‍👧 ️", "nul\0 \x1c byte", "aaaaaaaaaa" * 9, "'S 'T It'S", "x'  's"]
SCHEMA = "doc_id long, text string, n_bytes long, row long, k long, chunks long, map int, own string"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def drawn():
    draw = random.Random(3)
    alphabet = [*"ab'srelvtmd \n\t1é.,日0Zß", SPECIAL, " ", "the", " in", "'ll", "ing"]
    return [*ODD, *("".join(draw.choice(alphabet) for _ in range(draw.randrange(50))) for _ in range(400))]


def whole(machine, texts):
    return machine.whole(pa.array([t.encode() for t in texts], pa.binary())).tolist()


@pytest.mark.parametrize("states", [3, 40, tc.STATES])
def test_counter_equals_the_library_whatever_room_it_has(library, drawn, states):
    machine = tc.Transducer(PATH, states)
    for texts in (drawn, drawn[::-1], drawn[5:7], [""], []):
        assert whole(machine, texts) == library(texts)


def test_all_words_at_once_and_each_alone(library, monkeypatch, drawn):
    monkeypatch.setattr(tc, "LANE", 3)
    monkeypatch.setattr(tc, "STEP_BYTES", 50)
    assert whole(tc.Transducer.of(PATH), drawn) == library(drawn)


def test_very_long_words(library):
    texts = ["ab" * 40_000 + " c"] * 18 + ["-" * 70_000]
    assert whole(tc.Transducer.of(PATH), texts) == library(texts)


def test_neighbours_fit_as_their_encoding_says():
    machine, draw = tc.Transducer.of(PATH), random.Random(8)
    ids = sorted(machine.bytes_of)
    for _ in range(20_000):
        a, b = draw.choice(ids), draw.choice(ids[: draw.choice([300, len(ids)])])
        assert machine.fits(a, b) == (machine.encode(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])


def test_classes_of_characters_are_the_librarys():
    machine = tc.Transducer.of(PATH)
    for c in map(chr, [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F700)]):
        kind, pieces = machine._kind(c), machine.pieces
        joined = [len(pieces(x + c)) == 1 for x in ("b", "2", "?")]
        assert joined == [kind == k for k in (tc.LETTER, tc.NUMBER, tc.OTHER)]


@pytest.mark.parametrize("size", [1, 2, 5, 13, 40])
def test_maps_of_chunks_compose_to_the_whole(library, drawn, size):
    machine, draw = tc.Transducer.of(PATH), random.Random(size)
    for text, n in zip(drawn[:150], library(drawn[:150]), strict=True):
        data = text.encode()
        maps = [machine.chunk_map(data[max(0, k - 12) : k], data[k : k + size], data[k + size : k + size + 21], k == 0) for k in range(0, max(1, len(data)), size)]
        while len(maps) > 1:  # in any order of pairs
            k = draw.randrange(len(maps) - 1)
            maps[k : k + 2] = [machine.compose(maps[k], maps[k + 1])]
        assert maps[0][tc.NEW]["inner"] + machine.count_word(maps[0][tc.NEW]["tail"]) == n


@pytest.mark.parametrize("more", [{}, {"chunk_bytes": 30, "fan": 3}])
def test_operator_on_odd_rows(spark, library, more):
    texts = [*ODD, "word " * 30, "é" * 200, "one two", "one two"]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(7, None), (None, None), (7, "again")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x") for r in rows], SCHEMA)
    counts = library(t or "" for _, t in rows)
    want = [(i, len((t or "").encode()), n, n > 20) for (i, t), n in zip(rows, counts, strict=True)]
    assert sorted(map(tuple, tc.token_counts(spark, df, limit=20, **more).collect()), key=str) == sorted(want, key=str)
    assert tc.token_counts(spark, df.limit(0), **more).collect() == []


def test_query_equals_the_library_on_the_table(spark, sf, library):
    rows = table(spark, sf, "documents").collect()
    want = [(r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, library(r.text or "" for r in rows), strict=True)]
    found = list(map(tuple, QUERIES["op13_token_counts"](spark, sf).collect()))
    assert sorted(found) == sorted(want) and any(x[3] for x in found) and not all(x[3] for x in found)


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        tc.Transducer(vocabulary_path())
    assert np.array_equal(tc.GO[:, -1], np.arange(8))
