"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1; unlabelled text is every document outside the held-out fold,
whatever its label says. Labelled negatives are never used. The class prior is estimated from positives
and unlabelled text alone: a first network tells them apart on one half of the data, and on the other
half the prior is the least ratio of unlabelled to positive shares above a score, with a margin for chance.
The risk pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) is then minimised for a small network on features of
writing style. With the logistic loss its margin is the log odds of label 1, so it needs no calibration.

All unlabelled documents count in every step: their features are written once, each step is a pass over
them in which the tasks add up their part of the gradient, and the driver adds the positives' part.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_batches, materialise, text_of

#: Positive rows that the model is fitted on, at most.
MAX_LABELLED = 12_000
#: Sums of tasks that the driver takes; more are added up on executors first.
SUMS = 64
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Steps of the network that the prior comes from, and of the model; all are over all documents.
HIDDEN, PRIOR_STEPS, STEPS, RATE, DECAY = 24, 30, 60, 3e-2, 1e-4
#: Chance that the prior's margin is too small.
DOUBT = 0.1

# Classes of UTF-8 bytes whose pairs are counted.
BYTE_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"%#*$&@^~", b"()[]{}<>", b"'\"`", b"-_/\\+=", bytes(range(128, 256))]
CLASSES = len(BYTE_CLASSES) + 1
N_FEATURES = CLASSES * CLASSES + 12


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 1, dtype=np.int64)
    for k, members in enumerate(BYTE_CLASSES):
        table[list(members)] = k
    return table


_TABLE = _class_table()


def features(text: str) -> np.ndarray:
    """Shares of byte-class pairs, and measures of repetition and layout, over the whole text."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    kinds = _TABLE[np.frombuffer(raw, dtype=np.uint8)]
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(raw) - 1))
    words = text.split()
    n, lines = len(words), text.split("\n")
    seen = set(words)
    runs = sum(map(eq, words, words[1:]))
    short = sum(len(x) < 20 for x in lines)
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    tail = sum(not w[-1].isalnum() for w in words)
    out[CLASSES * CLASSES :] = [
        1.0, np.log1p(len(raw)) / 10, np.log1p(n) / 10, len(raw) / max(1, n) / 20, runs / max(1, n), np.sqrt(runs / max(1, n)),
        len(seen) / max(1.0, n**0.8), 1 - len(set(lines)) / len(lines), short / len(lines), upper / max(1, n), title / max(1, n), tail / max(1, n),
    ]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """features -> score in 0..1: one hidden layer, whose margin is the log odds of label 1."""

    def __init__(self, mean: np.ndarray | None = None, scale: np.ndarray | None = None, prior: float = 0.5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean = np.zeros(N_FEATURES) if mean is None else mean
        self.scale = np.ones(N_FEATURES) if scale is None else scale
        self.prior = prior
        self.w = [rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.first, self.second, self.steps = [0.0] * 4, [0.0] * 4, 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def loss(self, x: np.ndarray, sign: int) -> tuple[float, list[np.ndarray]]:
        """The sum of log(1 + exp(sign * margin)) over the rows of x, and its gradient."""
        x = self.scaled(x)
        h = np.tanh(x @ self.w[0] + self.w[1])
        z = h @ self.w[2] + self.w[3][0]
        d = sign * _sigmoid(sign * z)
        dh = np.outer(d, self.w[2]) * (1 - h * h)
        return float(np.logaddexp(0, sign * z).sum()), [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def step(self, gradient: list[np.ndarray]) -> None:
        """One step of Adam."""
        self.steps += 1
        for k, g in enumerate(gradient):
            g = g + DECAY * self.w[k]
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            self.w[k] = self.w[k] - RATE * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)


def descend(model: Model, positive: np.ndarray, unlabelled, steps: int, prior: float | None) -> Model:
    """Minimise the non-negative risk; where its negative part is below 0, step back on that. Without a
    prior: tell positives from unlabelled text. unlabelled(model) gives the mean loss and its gradient."""
    n = len(positive)
    for _ in range(steps):
        u_loss, u = unlabelled(model)
        _, plus = model.loss(positive, -1)
        p_loss, minus = model.loss(positive, 1)
        if prior is None:
            model.step([a / n + b for a, b in zip(plus, u, strict=True)])
            continue
        negative = [b - prior * c / n for b, c in zip(u, minus, strict=True)]
        if u_loss - prior * p_loss / n >= 0:
            model.step([prior * a / n + b for a, b in zip(plus, negative, strict=True)])
        else:
            model.step([-b for b in negative])
    return model


def estimate_prior(positive: np.ndarray, held: np.ndarray, edges: np.ndarray) -> float:
    """The share of positives in unlabelled text, from scores that tell the two apart.

    Above a score that negatives hardly reach, unlabelled text holds prior times as large a share as
    positives do, and above any score at least that. So the prior is the least ratio of the shares; the
    margin for chance keeps scores out that too few rows reach. positive are the positives' margins,
    held the number of unlabelled ones at or above each of the (falling) edges, the last of which is
    below all.
    """
    if not len(positive) or not held[-1]:
        return 0.5
    share, own = held / held[-1], np.searchsorted(-np.sort(positive)[::-1], -edges, side="right") / len(positive)
    margin = np.sqrt(np.log(4 / DOUBT) / (1 / (1 / len(positive) + 1 / held[-1])) / 2)
    at = np.argmin(np.where(own > margin, (share + margin) / np.maximum(own, 1e-9), np.inf))
    return float(np.clip(share[at] / own[at], 0.02, 0.98)) if own[at] > margin else 0.5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1))


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(np.float64)


def summed(table: DataFrame, part, length: int) -> np.ndarray:
    """The sum over all rows of table (half, x) of part(half, x), vectors of that length: added up within
    tasks, then (of many tasks) on executors, and a bounded number of them on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                total += part(b.column("half").to_numpy(), _unpack(b.column("x")))
        salt = TaskContext.get().partitionId() % SUMS if TaskContext.get() else 0
        yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["salt", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["salt", "v"])

    sums = table.mapInArrow(run, "salt int, v binary")
    if len(table.inputFiles()) > SUMS:
        sums = sums.repartition(SUMS // 4, "salt").mapInArrow(add, "salt int, v binary")
    return np.sum([np.zeros(length), *(np.frombuffer(v) for v in sums.toArrow()["v"].to_pylist())], axis=0)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on rows outside the held-out fold: at most max_labelled positive rows, the first by a hash of the id
    and then of the text (their ids, bounded alike, are broadcast), and all documents as unlabelled text."""
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    trusted = marks.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y")).where("y = 1").select("doc_id")
    # Hashes up to a bound that leaves little more than are wanted, so that no task sends many to be ordered.
    place, n_trusted = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), trusted.count()
    if n_trusted > max_labelled:
        trusted = trusted.where(place <= int((1 << 40) * min(1.0, (max_labelled + 6 * max_labelled**0.5 + 9) / n_trusted)))
    trusted = trusted.orderBy(place, "doc_id").limit(max_labelled)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("half"), pa.array([features(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["half", "x"])

    def measure_placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (made,) = measure([b])
            yield pa.RecordBatch.from_arrays([*made.columns, b.column("place"), b.column("mark")], ["half", "x", "place", "mark"])

    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    # An id may have any number of rows: they are bounded after the join, by the same hash and that of the text.
    own = rows.join(F.broadcast(trusted), "doc_id").select(half, place.alias("place"), F.xxhash64("text").alias("mark"), "text")
    picked = own.mapInArrow(measure_placed, "half int, x binary, place long, mark long").orderBy("place", "mark").limit(max_labelled).select("half", "x").toArrow()
    if not picked.num_rows:
        return Model()
    positive, side = _unpack(picked["x"]), picked["half"].to_numpy()
    seen = rows.where(fold(F.col("doc_id")) != HELD_OUT).select(half, "text").mapInArrow(measure, "half int, x binary")
    seen = materialise(spark, seen, "quality-features")

    # Mean and spread, halfway between positives and unlabelled text.
    moments = lambda _, x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
    n, *sums = summed(seen, moments, 1 + 2 * N_FEATURES)
    both = [(np.array(sums).reshape(2, -1)[k] / max(n, 1) + (positive ** (k + 1)).mean(0)) / 2 for k in range(2)]
    mean, scale = both[0], np.maximum(np.sqrt(np.maximum(both[1] - both[0] ** 2, 0)), 1e-3)

    sizes = [1, 1, *(w.size for w in Model().w)]

    def unlabelled_part(only: int | None):
        def at(model: Model) -> tuple[float, list[np.ndarray]]:
            def part(halves: np.ndarray, x: np.ndarray) -> np.ndarray:
                x = x if only is None else x[halves == only]
                loss, gradient = model.loss(x, 1)
                return np.concatenate([[len(x), loss], *(g.ravel() for g in gradient)])

            count, loss, *gradient = np.split(summed(seen, part, sum(sizes)), np.cumsum(sizes)[:-1])
            k = max(1.0, float(count[0]))
            return float(loss[0]) / k, [g.reshape(w.shape) / k for g, w in zip(gradient, model.w, strict=True)]

        return at

    first = Model(mean, scale)
    own, others = positive[side == 0], first.margin(positive[side == 1])
    prior = 0.5
    if len(own) and len(others):
        others = descend(first, own, unlabelled_part(0), PRIOR_STEPS, None).margin(positive[side == 1])
        edges = np.append(np.unique(np.quantile(others, np.linspace(0, 1, 501)))[::-1], -np.inf)
        above = lambda halves, x: np.searchsorted(np.sort(first.margin(x[halves == 1])), edges, side="left")
        count = lambda halves, x: np.full(len(edges), (halves == 1).sum()) - above(halves, x)
        prior = estimate_prior(others, summed(seen, count, len(edges)), edges)
    return descend(Model(mean, scale, prior), positive, unlabelled_part(None), STEPS, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text and score of every row; the whole text is read, the label columns never."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x).astype(np.float64))], ["doc_id", "score"])

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    labels (doc_id, quality) teach only outside the held-out fold. Null text counts as empty and gets
    a score too; a null id is not held out; repeated rows are scored alike; without positive labels every
    score comes from an untrained model. Other columns are ignored; an empty table gives an empty result.
    """
    out = score(docs, train(spark, docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score at least threshold, with all their columns.

    Null text counts as empty, and is scored too; rows that share an id and repeated rows are scored
    each by its own text; a null id is like any other. Columns may have any names; an empty table stays
    empty; without positive labels every score comes from an untrained model.
    """
    hold_batches(spark)
    model = train(spark, docs, labels)

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        return pd.Series(model.score(np.stack([features(t) for t in texts])).astype(float) if len(texts) else [], dtype=float)

    return docs.where(rate(F.coalesce(docs["text"], F.lit(""))) >= threshold)
