"""Language-model scores: a unigram baseline over words, and a lattice over subword pieces.

The lattice model takes its pieces from a published vocabulary, with probabilities from the training
documents: one distribution over the pieces and the document's end. A document's probability is the sum
over all its segmentations into pieces, then the end, by a forward recursion in log space. A piece never
reaches over a word's start, so that sum is the product of the words' own sums. Words are scored once
each, not once for every occurrence: the most frequent ones, in a table of bounded size, are looked up in
the tasks; occurrences of all others are joined. Longer words than the table takes enter it by their digest
if they are frequent, so that no word is a hot key of that join.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_of

PIECES = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
#: Words looked up within tasks: at most so many, none longer than so many bytes; the rest are joined.
TABLE_WORDS, TABLE_WORD_BYTES = 250_000, 64
#: Words that hold 1/HOT_KEYS of all occurrences (so at most HOT_KEYS words) are looked up whatever their length.
HOT_KEYS = 1000
#: Distinct words a task counts before it passes its counts on.
FLUSH_WORDS = 400_000

#: Bytes 9-13 become spaces and A-Z lower case; no byte of a longer UTF-8 character is touched.
_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ") if w]


def training(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1)) != HELD_OUT


def _pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count in training rows, count in all rows) of a task."""
    counts: Counter = Counter()
    others: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for of, train in ((counts, 1), (others, 0)):
            n = pa.array(of.values(), pa.int64())
            none = pa.array(np.zeros(len(n), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(of.keys(), pa.binary()), n if train else none, n], ["word", "c", "n"])
            of.clear()

    for b in batches:
        for text, train in zip(b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
            (counts if train else others).update(words_of(text))
        if len(counts) + len(others) >= FLUSH_WORDS:
            yield from flush()
    if counts or others:
        yield from flush()


def count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(piece, count) of the vocabulary's own segmentation of each training word, weighted by its count."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    total = np.zeros(model.get_piece_size())
    for b in batches:
        counts = b.column("c").to_pylist()
        for ids, c in zip(model.encode([w.decode("utf-8", "replace") for w in b.column("word").to_pylist()], num_threads=1), counts, strict=True):
            for i in ids:
                total[i] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["piece", "c"])


class Lattice:
    """log probabilities of words, summed over all segmentations, and of the document's end."""

    def __init__(self, log_p: dict[str, float], byte_p: list[float], end: float = 0.0):
        self.log_p, self.byte_p, self.end = log_p, byte_p, end
        self.longest = max(map(len, log_p), default=1)

    @classmethod
    def trained(cls, path: str, counts: dict[int, int], ends: int) -> Lattice:
        """Pieces of the file and the end, with add-one probabilities that sum to 1 over them."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
        total = sum(counts.get(i, 0) + 1 for i in own) + ends + 1
        log_p, byte_p = {}, [-math.inf] * 256
        for i in own:
            p = math.log((counts.get(i, 0) + 1) / total)
            if model.is_byte(i):
                byte_p[int(model.id_to_piece(i)[3:5], 16)] = p
            else:
                log_p[model.id_to_piece(i)] = p
        return cls(log_p, byte_p, math.log((ends + 1) / total))

    def word(self, word: str) -> float:
        return self.string("▁" + word)

    def string(self, s: str) -> float:
        """Forward recursion over end positions; a character that is no piece is spelled in bytes."""
        n, log_p, longest = len(s), self.log_p, self.longest
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if a is None:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                p = log_p.get(s[i:j])
                if p is None:
                    if j > i + 1:
                        continue
                    p = sum(self.byte_p[b] for b in s[i].encode("utf-8", "surrogatepass"))
                p += a
                was = alpha[j]
                if was is None:
                    alpha[j] = p
                elif was > p:
                    alpha[j] = was + math.log1p(math.exp(p - was))
                else:
                    alpha[j] = p + math.log1p(math.exp(was - p))
        return alpha[n]  # type: ignore[return-value]


def score_words(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lat = [lattice.word(w.decode("utf-8", "replace")) / math.log(10) for w in b.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), b.column("n"), pa.array(lat, pa.float64())], ["word", "c", "n", "lat"])


def place_of(word: bytes) -> bytes:
    """A word's key in the table: itself, or for a long one a digest, which no word is (it has a space)."""
    return word if len(word) <= TABLE_WORD_BYTES else b" " + hashlib.sha1(word).digest()


_OCCURS = "rid long, doc_id long, train boolean, word binary, n long, n_tokens long, n_known long, base double, lat double"


def look_up(batches: Iterator[pa.RecordBatch], table: dict[bytes, tuple[int, float, float]], end: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """A row for each document with what the table knows, and a row for each other distinct word in it.

    A document's own row has a word that no text can contain (it holds a space).
    """
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            rows: list[tuple] = []
            for rid, doc_id, train, text in zip(*(part.column(c).to_pylist() for c in ("rid", "doc_id", "train", "text")), strict=True):
                words = words_of(text)
                known, base, lat = 0, end[0], end[1]
                for w, n in Counter(words).items():
                    got = table.get(place_of(w))
                    if got is None:
                        rows.append((rid, doc_id, train, w, n, 0, 0, 0.0, 0.0))
                    else:
                        known += n * (got[0] > 0)
                        base += n * got[1]
                        lat += n * got[2]
                rows.append((rid, doc_id, train, b" %d" % rid, 0, len(words) + 1, known, base, lat))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _OCCURS.split(", ")])


def score_documents(spark: SparkSession, docs: DataFrame, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Learns from rows whose crc32(doc_id as text) modulo 7 is not 2 (a null id is a training row). A
    document is its words, lower-cased in A-Z, then one end. Null text counts as empty: the end
    alone. Repeated rows are scored each for itself and count as often as they occur; other columns
    are ignored; an empty table gives an empty result.
    """
    path = _pieces_path()
    own = F.col("doc_id").cast("long").alias("doc_id")
    rows = text_of(docs, own).withColumn("train", training(F.col("doc_id"))).select("doc_id", "train", "text")
    counted = rows.select("train", "text").mapInArrow(count_words, "word binary, c long, n long")
    words = materialise(spark, counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")

    ends = rows.where("train").count()  # reads the ids alone
    sums = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.sum("n").alias("all")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    base_of = lambda c: math.log10((c + 1) / (n + v + 1))

    pieces = words.where("c > 0").mapInArrow(lambda it: count_pieces(it, path), "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()
    counts = {r["piece"]: r["c"] for r in pieces}
    lattice = Lattice.trained(path, counts, ends)
    scored = materialise(spark, words.mapInArrow(lambda it: score_words(it, lattice), "word binary, c long, n long, lat double"), "word-scores")

    long = F.length("word") > TABLE_WORD_BYTES
    short = scored.where(~long).orderBy(F.desc("n"), "word").limit(table_words).select("word", "c", "lat")
    hot = scored.where(long & (F.col("n") * HOT_KEYS >= (sums["all"] or 0))).select(F.concat(F.lit(b" "), F.unhex(F.sha1("word"))).alias("word"), "c", "lat")
    top = short.unionByName(hot).toArrow()
    table = {bytes(w): (c, base_of(c), lat) for w, c, lat in zip(top["word"].to_pylist(), top["c"].to_pylist(), top["lat"].to_pylist(), strict=True)}
    del top
    held = spark.sparkContext.broadcast(table)
    end = (base_of(ends), lattice.end / math.log(10))

    occurs = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "train", "text")
    occurs = occurs.mapInArrow(lambda it: look_up(it, held.value, end), _OCCURS)
    rest = scored.select("word", F.col("c").alias("_c"), F.col("lat").alias("_lat"))
    met = occurs.join(rest, "word", "left")
    times = F.col("n").cast("double")
    base_rest = F.log10((F.col("_c") + 1) / F.lit(float(n + v + 1)))
    out = met.groupBy("rid", "doc_id", "train").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("_c") > 0, F.col("n")).otherwise(0)) + F.lit(int(ends > 0))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(F.col("_c").isNotNull(), times * base_rest).otherwise(0.0))).alias("base_score"),
        (F.sum("lat") + F.sum(F.when(F.col("_c").isNotNull(), times * F.col("_lat")).otherwise(0.0))).alias("score"),
    )
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
