"""Secret scan: fixed patterns, and a randomness test battery with false-discovery control.

Patterns give the base spans. The battery looks at every other run of key-like characters: it infers
the smallest encoding that holds the run and tests it for randomness in that encoding: chi-squared for
uniform use of the alphabet, the number of runs of its two halves, and the serial correlation. The three
statistics, as normal scores, are combined into a sum of squares, which is small for random text and
large for ordinary text.

A run is found when ordinary text would hardly look so random. How ordinary text in an encoding looks
comes from the corpus itself: a Markov chain of the pairs of characters in all documents, restricted to
the encoding's alphabet, gives the combined statistic's distribution at each of a range of lengths. The
resulting p-values go through a Benjamini-Hochberg step in each length class, over all documents.

Names put together from words (in CamelCase, with underscores, as paths) are no such chain: where words meet,
case and separators change as the chain never saw. A run half of which is made of words that the corpus
itself uses elsewhere is therefore ordinary text, and takes no part in the tests.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, skew_join, text_of

# The base patterns, in the order in which kinds are listed.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ["password", "passwd", "secret", "token", "api"]
_DIGITS, _LOWER, _UPPER, _VOWELS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiouAEIOU"
# Encodings from the smallest alphabet up, each with the characters of its first half for the runs test.
ENCODINGS = [
    ("decimal", _DIGITS, "01234"),
    ("hex", _DIGITS + "abcdef", _DIGITS),
    ("hex upper", _DIGITS + "ABCDEF", _DIGITS),
    ("lower", _LOWER, _VOWELS),
    ("upper", _UPPER, _VOWELS),
    ("base32", _UPPER + "234567", _VOWELS),
    ("base36", _DIGITS + _LOWER, _DIGITS),
    ("base36 upper", _DIGITS + _UPPER, _DIGITS),
    ("base62", _DIGITS + _UPPER + _LOWER, _LOWER),
    ("base64", _DIGITS + _UPPER + _LOWER + "+/", _LOWER),
    ("base64url", _DIGITS + _UPPER + _LOWER + "-_", _LOWER),
    ("any", _DIGITS + _UPPER + _LOWER + "+/-_", _LOWER),
]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Discoveries are held to this false-discovery rate.
FDR = 0.01
#: Runs of more characters than this are not random, or are encoded data, whose pieces are tested one by one.
PIECE = 512
#: Bins of -log10(p) from 0 up, a tenth each: thresholds need only their counts.
BINS = 600
LENGTHS = [24, 32, 48, 64, 128, 512]
#: Lengths at which ordinary text is drawn, and draws for each encoding. A run is held against the longest that
#: is not longer than itself: shorter ordinary text looks more random, so p-values err upwards.
GRID, DRAWS = [20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512], 3000
#: A word of a run has at least so many letters, and counts where so many documents use it outside such runs.
WORD_LETTERS, WORD_DOCS = 3, 3
SYMBOLS = _DIGITS + _UPPER + _LOWER + "+/-_"


def _place(alphabet: str) -> np.ndarray:
    out = np.full(256, -1, np.int64)
    out[list(alphabet.encode())] = np.arange(len(alphabet))
    return out


_PLACES = [_place(alphabet) for _, alphabet, _ in ENCODINGS]
_SYMBOL = _place(SYMBOLS)


def character_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def infer_encoding(run: str) -> int | None:
    """The place in ENCODINGS of the smallest alphabet that holds the run."""
    raw = np.frombuffer(run.rstrip("=").encode(), np.uint8)
    return next((i for i, place in enumerate(_PLACES) if len(raw) and (place[raw] >= 0).all()), None)


def battery(values: np.ndarray, encoding: int) -> np.ndarray:
    """For each row of values (places in the encoding's alphabet), the normal scores of the three tests
    under 'uniformly random': chi-squared (how far from uniform), runs of the two halves, serial correlation."""
    _, alphabet, first = ENCODINGS[encoding]
    m, n = values.shape
    k = len(alphabet)
    counts = np.bincount((np.arange(m)[:, None] * k + values).ravel(), minlength=m * k).reshape(m, k)
    chi, df = (counts.astype(float) ** 2).sum(1) * k / n - n, k - 1
    uniform = ((np.maximum(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    half = np.isin(np.arange(k), [alphabet.index(c) for c in first if c in alphabet])
    q = half.mean()
    change, both = 2 * q * (1 - q), q * (1 - q)
    changes = (half[values[:, 1:]] != half[values[:, :-1]]).sum(1)
    var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change * change)
    runs = (changes - (n - 1) * change) / math.sqrt(max(var, 1e-9))
    centred = values - values.mean(1, keepdims=True)
    spread = (centred**2).sum(1)
    serial = np.where(spread > 0, ((centred[:, 1:] * centred[:, :-1]).sum(1) / np.maximum(spread, 1e-9) + 1 / n) * math.sqrt(n), math.sqrt(n))
    return np.stack([uniform, runs, serial], axis=1)


def combined(scores: np.ndarray) -> np.ndarray:
    """Sum of squares of the normal scores; a use of the alphabet that is too even is no sign of ordinary text."""
    return np.maximum(scores[:, 0], 0) ** 2 + scores[:, 1] ** 2 + scores[:, 2] ** 2


def measure_run(run: str) -> tuple[int, int, float] | None:
    """(encoding, length, combined statistic) of a run; that of its most ordinary piece if it is long."""
    encoding = infer_encoding(run)
    if encoding is None:
        return None
    values = _PLACES[encoding][np.frombuffer(run.rstrip("=").encode(), np.uint8)]
    n = len(values)
    size = min(n, PIECE)
    worst = max(float(combined(battery(values[at : at + size][None, :], encoding))[0]) for at in range(0, n - size + 1, size))
    return encoding, n, worst


class Ordinary:
    """Distributions of the combined statistic over ordinary text, by encoding and length."""

    def __init__(self, pairs: np.ndarray, draws: int = DRAWS, seed: int = 5):
        """pairs: counts of pairs of SYMBOLS in the corpus."""
        self.held: list[list[np.ndarray]] = []
        self.shape: list[list[tuple[float, float]]] = []
        for e, (_, alphabet, _) in enumerate(ENCODINGS):
            rng = np.random.default_rng([seed, e])
            own = [SYMBOLS.index(c) for c in alphabet]
            # A tenth of a count for each pair keeps characters that the corpus lacks possible, and no more.
            chain = pairs[np.ix_(own, own)].astype(float) + 0.1 / len(own)
            start = np.cumsum(chain.sum(1))
            steps = np.cumsum(chain, axis=1)
            now = np.minimum(np.searchsorted(start, rng.random(draws) * start[-1], side="right"), len(own) - 1)
            drawn = np.empty((draws, max(GRID)), np.int64)
            for i in range(drawn.shape[1]):
                drawn[:, i] = now
                row = steps[now]
                now = np.minimum((row <= rng.random(draws)[:, None] * row[:, -1:]).sum(1), len(own) - 1)
            at = [np.sort(combined(battery(drawn[:, :n], e))) for n in GRID]
            self.held.append(at)
            logs = [np.log(np.maximum(x, 1e-3)) for x in at]
            self.shape.append([(float(x.mean()), float(max(x.std(), 1e-3))) for x in logs])

    def log_p(self, encoding: int, length: int, statistic: float) -> float:
        """log10 of the chance that ordinary text has so small a statistic. Beyond the draws it is the
        normal tail of the statistic's logarithm."""
        g = max(0, sum(length >= n for n in GRID) - 1)
        held = self.held[encoding][g]
        below = int(np.searchsorted(held, statistic, side="right"))
        if below:
            return math.log10((below + 1) / (len(held) + 1))
        mean, sd = self.shape[encoding][g]
        z = (math.log(max(statistic, 1e-3)) - mean) / sd
        tail = math.erfc(min(26.0, -z / math.sqrt(2))) / 2 if z < 0 else 1.0
        return min(-math.log10(len(held) + 1), math.log10(max(tail, 1e-300)))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the pattern matches that are long enough."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), "hex", m.end()) for m in _HEX_LONG.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


#: The same as HEX matches of 24 or more: a match takes the whole run.
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


_PIECE = re.compile(rf"[A-Z]?[a-z]{{{WORD_LETTERS - 1},}}|[A-Z]{{{WORD_LETTERS},}}(?![a-z])")
_WORD = re.compile(rf"(?<![^\W_])[a-z]{{{WORD_LETTERS},}}(?![^\W_])")


def words_within(run: str) -> list[str]:
    """The words that a run may be put together from: its letters between changes of case and other characters."""
    return [w for m in _PIECE.findall(run) if len(w := m.lower()) >= WORD_LETTERS]


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n): the words of ordinary text and the documents of a batch that use them."""
    for pdf in batches:
        counts: Counter[str] = Counter()
        for text in pdf["text"]:
            counts.update(set(_WORD.findall(CANDIDATE.sub(" ", text).lower())))
        yield pd.DataFrame({"word": np.array(list(counts), dtype=object), "n": np.array(list(counts.values()), dtype=np.int64)})


def spoken_runs(spark: SparkSession, some: DataFrame, texts: DataFrame) -> DataFrame:
    """(rid, spoken): for each document, the places of its runs that are made of words the corpus uses."""
    each = some.select("rid", F.posexplode("words").alias("k", "ws"), "lengths")
    pieces = materialise(spark, each.select("rid", "k", F.get("lengths", F.col("k")).alias("size"), F.explode("ws").alias("word")), "run-words")
    asked = pieces.groupBy("word").agg(F.count("*").alias("times"))
    used = texts.mapInPandas(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("docs")).where(F.col("docs") >= WORD_DOCS)
    known = materialise(spark, asked.join(used, "word").select("word", "times", F.lit(True).alias("used")), "known-words")
    met = skew_join(pieces, known, "word", "times", "rid", max(1, pieces.count())).where("used")
    covered = met.groupBy("rid", "k").agg(F.sum(F.length("word")).alias("letters"), F.first("size").alias("size")).where("2 * letters >= size")
    return covered.groupBy("rid").agg(F.collect_set("k").alias("spoken"))


_SCANNED = "rid long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, starts array<int>, ends array<int>, encodings array<int>, lengths array<int>, statistics array<double>, words array<array<string>>"


def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for rid, doc_id, text in zip(pdf["rid"], pdf["doc_id"], pdf["text"], strict=True):
            spans = base_spans(text)
            found = [[], [], [], [], [], []]
            for m in CANDIDATE.finditer(text):
                if any(a < m.end() and m.start() < b for a, _, b in spans):
                    continue
                result = measure_run(m[0])
                if result:
                    for k, x in enumerate((m.start(), m.end(), *result, words_within(m[0]))):
                        found[k].append(x)
            kinds = [k for _, k, _ in spans]
            text_spans = joined(spans)
            rows.append((rid, doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(text_spans.encode()).hexdigest(), text_spans, *found))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _SCANNED.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


_ORDINARY = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}|[^A-Za-z0-9+/_-]+")


def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of pairs of key-like characters in a task's ordinary text, which is what no candidate holds."""
    k = len(SYMBOLS)
    total = np.zeros(k * k, np.int64)
    for pdf in batches:
        for text in pdf["text"]:
            v = _SYMBOL[np.frombuffer(_ORDINARY.sub("", text).encode("ascii", "ignore"), np.uint8)]
            total += np.bincount(v[:-1] * k + v[1:], minlength=k * k) if len(v) > 1 else 0
    used = np.flatnonzero(total)
    yield pd.DataFrame({"pair": used, "n": total[used]})


def thresholds(counts: list[tuple[int, int, int]], rate: float = FDR) -> dict[int, int]:
    """The least bin that Benjamini and Hochberg's step accepts in each length class.

    counts: (class, bin, number). A bin's p-value is that of its lower edge, so none is understated.
    """
    out = {}
    for c in {x[0] for x in counts}:
        here = {b: n for k, b, n in counts if k == c}
        tests, above, least = sum(here.values()), 0, None
        for b in sorted(here, reverse=True):
            above += here[b]
            if b > 0 and 10 ** (-b / 10) <= rate * above / tests:
                least = b
        if least is not None:
            out[c] = least
    return out


def find_secrets(spark: SparkSession, docs: DataFrame, rate: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs (doc_id, text).

    spans are kind:start:end in code points, by start, comma-joined; base spans always stay, spans of
    kind 'random' are added where none overlaps. Every run of 20 or more key-like characters outside
    the base spans is tested, but for those made of words that the corpus uses. Null text counts as empty (no spans, the digest of the empty
    string); repeated rows and ids get a row each; other columns are ignored; an empty table gives an
    empty result. What reaches the driver has a fixed bound: the counts of pairs of 66 characters, and
    of 7 * BINS levels, over all documents.
    """
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "text")
    scanned = materialise(spark, rows.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(scan_batches, _SCANNED), "secrets")
    some = scanned.where(F.size("starts") > 0)
    ordinary = None
    if some.limit(1).count():
        pairs = np.zeros(len(SYMBOLS) ** 2, np.int64)
        for pair, n in rows.select("text").mapInPandas(count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():
            pairs[pair] = n
        ordinary = Ordinary(pairs.reshape(len(SYMBOLS), -1))
        some = some.join(spoken_runs(spark, some, rows.select("text")), "rid", "left")

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            classes, bins, kept = [], [], []
            for es, ns, ts, spoken in zip(pdf["encodings"], pdf["lengths"], pdf["statistics"], pdf["spoken"], strict=True):
                left = [k for k in range(len(ns)) if spoken is None or k not in spoken]
                kept.append(left)
                classes.append([length_class(ns[k]) for k in left])
                bins.append([min(BINS - 1, int(-10 * ordinary.log_p(es[k], ns[k], ts[k]))) for k in left])
            places = {c: [[int(x[k]) for k in left] for x, left in zip(pdf[c], kept, strict=True)] for c in ("starts", "ends")}
            yield pdf.drop(columns=["encodings", "lengths", "statistics", "spoken"]).assign(**places, **{"class": classes, "bin": bins})

    keep = "n_assign long, n_access long, n_hex long, base_sha256 string, base string, starts array<int>, ends array<int>"
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "base", "starts", "ends"]
    none = F.array().cast("array<int>")
    plain = scanned.where(F.size("starts") == 0).select("doc_id", *own, none.alias("class"), none.alias("bin"))
    if ordinary is None:
        tested = plain
    else:
        # ids stay on the JVM as text: a missing one must not turn the others into floats
        asked = some.select(F.col("doc_id").cast("string").alias("doc_id"), *own, "encodings", "lengths", "statistics", "spoken")
        found = materialise(spark, asked.mapInPandas(levels, f"doc_id string, {keep}, class array<int>, bin array<int>"), "secret-levels")
        tested = plain.unionByName(found.withColumn("doc_id", F.col("doc_id").cast("long")))
    counted = tested.select(F.explode(F.arrays_zip("class", "bin")).alias("x")).groupBy("x.class", "x.bin").count().collect() if ordinary else []
    accept = thresholds([tuple(r) for r in counted], rate)

    @F.pandas_udf("string")
    def merged(base: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series, bins: pd.Series) -> pd.Series:
        out = []
        for text, *found in zip(base, starts, ends, kinds, bins, strict=True):
            spans = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in text.split(",") if s)]
            spans += [(int(a), "random", int(b)) for a, b, c, v in zip(*found, strict=True) if v >= accept.get(c, BINS)]
            out.append(joined(spans))
        return pd.Series(out)

    all_spans = F.when(F.size("starts") > 0, merged("base", "starts", "ends", "class", "bin")).otherwise(F.col("base"))
    out = tested.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", all_spans.alias("spans"))
    return out.withColumn("n_random", (F.size(F.split("spans", "random:")) - 1).cast("long"))
