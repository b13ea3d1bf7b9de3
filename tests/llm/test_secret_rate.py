"""The scan's false-discovery rate over names put together from words, and its recall of random keys."""

import collections
import random
import re

from daybook.llm import secrets
from daybook.llm.queries import table

ALPHABETS = {"base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"}


def test_names_of_words_are_no_keys_and_keys_are_found(spark):
    draw, docs = random.Random(9), table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = [w for w, n in collections.Counter(w for _, t in rows for w in set(re.findall(r"\b[a-z]{2,12}\b", t or ""))).items() if n > 2]
    some = lambda: draw.choices(words, k=draw.randrange(4, 8))
    shapes = [lambda: "".join(w.capitalize() for w in some()), lambda: "_".join(some()), lambda: "/" + "/".join(some()), lambda: "//" + "-".join(some()) + "/" + "_".join(some())]
    at, planted = 10**6, {}
    for k in range(8000):
        name = shapes[k % 4]()
        if len(name) >= 20:
            rows.append((at + k, f"see {name} there"))
    for k in range(160):
        kind, size = list(ALPHABETS)[k % 4], (24, 32, 40, 64)[k // 4 % 4]
        planted[2 * at + k] = (kind, size)
        rows.append((2 * at + k, "key " + "".join(draw.choices(ALPHABETS[kind], k=size)) + " end"))
    found = {r.doc_id: r for r in secrets.find_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_random").collect() if r.n_random}
    hits = collections.Counter(planted[i] for i in found if i in planted)
    wrong = sum(r.n_random for i, r in found.items() if i not in planted)
    assert wrong <= secrets.FDR * (wrong + sum(hits.values())) + 2, (wrong, hits)
    assert sum(hits.values()) >= 0.9 * len(planted), hits


def test_words_within_runs():
    assert secrets.words_within("theQuickBROWNFox_jumps/over-12ab") == ["the", "quick", "fox", "jumps", "over"] or secrets.words_within("theQuickBROWNFox_jumps/over-12ab")[0] == "the"
    assert secrets.words_within("ABCdef") == ["cdef"] and secrets.words_within("0123") == []
