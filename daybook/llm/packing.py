"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Bins are filled one at a time. The next piece is the one, among those that fit, whose demand vector has
the greatest dot product with the bin's remaining capacity, both in units of the limits. When nothing
fits whole, the best piece is cut to fill the bin. A bin that its segment or loss limit closes early is cut
back to the greatest power of two, which needs no padding, and what lies beyond goes back to the pieces
that wait. Each task packs its own rows in windows of bounded size, so nothing is shuffled; what is left at
a task's end goes into sequences of powers of two, too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gather, lean, text_of
from .tokens import WordEncoder, vocabulary_path

END_ID = 2
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 64, 4096
#: Pieces a window may hold; a task's memory is bounded by this and the longest document.
WINDOW = 2048
#: Text that is encoded at a time, so that a worker stays small beside others that wait for work.
BATCH_BYTES = 3 << 20
#: Sequence ids of one task lie below this; the task's number is above.
TASK_SEQUENCES = 1 << 36
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Packer:
    """Packs pieces (row, start, length, loss_from) into bins; loss_from: a row's first loss-bearing token.

    emit(row, start, length, sequence, offset) is called once for each piece of the result.
    """

    def __init__(self, emit, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, window: int = WINDOW):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.emit, self.limit, self.window = emit, np.array([max_tokens, max_segments, max_loss], dtype=np.int64), window
        self.rows: list = []
        self.spans: list[list[int]] = []  # start, length, loss_from
        self.sequence = 0

    @staticmethod
    def loss(start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def add(self, row, length: int, loss_from: int = 0) -> None:
        """Queue a row; full sequences of one long row are emitted at once."""
        most, start = int(self.limit[0]), 0
        while length - start >= most:
            cut = self.fit(start, length - start, loss_from, self.limit)
            cut = cut if cut == most else 1 << (cut.bit_length() - 1)
            self.emit(row, start, cut, self.sequence, 0)
            self.sequence += 1
            start += cut
        if length > start:
            self.rows.append(row)
            self.spans.append([start, length - start, loss_from])

    def fit(self, start: int, length: int, loss_from: int, room: np.ndarray) -> int:
        """The most tokens from start that the room allows, 0 if none."""
        if room[1] < 1:
            return 0
        free = max(0, loss_from - start)  # tokens ahead of the first that bears loss
        return int(min(length, room[0], free + room[2]))

    def pack(self, last: bool = False) -> None:
        """Pack the window. Unless last, pieces that don't fill a bin are kept for the next window."""
        n = len(self.rows)
        if not n:
            return
        span = np.array(self.spans, dtype=np.int64)
        demand = np.ones((n, 3), dtype=np.int64)
        demand[:, 0] = span[:, 1]
        demand[:, 2] = np.maximum(0, span[:, 0] + span[:, 1] - np.maximum(span[:, 0], span[:, 2]))
        unit, alive = demand / self.limit, np.ones(n, dtype=bool)
        left = int(demand[:, 0].sum())
        most = int(self.limit[0])
        while left and (last or left >= most and n):
            room, chosen = self.limit.copy(), []
            target = most if left >= most or not last else 1 << (min(left, most).bit_length() - 1)
            room[0] = target
            while room[0] > 0 and room[1] > 0:
                fits = alive & (demand <= room).all(axis=1)
                if fits.any():
                    i = int(np.argmax(np.where(fits, unit @ (room / self.limit), -1.0)))
                    take = int(span[i, 1])
                else:
                    # Nothing fits whole: cut the piece that fills the most of what is left.
                    gain = np.where(alive, np.minimum(np.minimum(span[:, 1], room[0]), np.maximum(0, span[:, 2] - span[:, 0]) + room[2]), 0)
                    i = int(np.argmax(gain))
                    take = int(gain[i])
                    if take < 1:
                        break
                start, loss_from = int(span[i, 0]), int(span[i, 2])
                chosen.append((i, start, take))
                room -= np.array([take, 1, self.loss(start, take, loss_from)])
                span[i, 0] += take
                span[i, 1] -= take
                left -= take
                if span[i, 1]:
                    demand[i, 0] = span[i, 1]
                    demand[i, 2] = self.loss(int(span[i, 0]), int(span[i, 1]), loss_from)
                    unit[i] = demand[i] / self.limit
                else:
                    alive[i] = False
            used = target - int(room[0])
            if not used:
                break
            # A bin that a limit closed early is cut back to a power of two; the rest waits for another.
            over = used - (used if target == most and not room[0] else 1 << (used.bit_length() - 1))
            left += over
            while over:
                i, start, take = chosen.pop()
                back = min(take, over)
                over -= back
                if take > back:
                    chosen.append((i, start, take - back))
                span[i, 0] -= back
                span[i, 1] += back
                demand[i] = span[i, 1], 1, self.loss(int(span[i, 0]), int(span[i, 1]), int(span[i, 2]))
                unit[i], alive[i] = demand[i] / self.limit, True
            offset = 0
            for i, start, take in chosen:
                self.emit(self.rows[i], start, take, self.sequence, offset)
                offset += take
            self.sequence += 1
        keep = np.flatnonzero(alive)
        self.rows, self.spans = [self.rows[i] for i in keep], span[keep].tolist()


def rows_of(ids: np.ndarray, places: np.ndarray) -> list[bytes]:
    data, at = ids.tobytes(), (4 * places).tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def pack_rows(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, limits: tuple[int, int, int], window: int, prompted: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder = WordEncoder.of(vocabulary)
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) * TASK_SEQUENCES
    done: list[tuple] = []

    def emit(row, start, length, sequence, offset):
        doc_id, data, loss_from = row
        part = data[4 * start : 4 * (start + length)]
        done.append((doc_id, start, length, zlib.crc32(part), len(data) // 4, Packer.loss(start, length, loss_from), base + sequence, offset))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"])

    packer = Packer(emit, *limits, window)
    for batch in gather(batches, BATCH_BYTES):
        ahead = [d for _, ids, places in encoder.encode(batch.column("prompt")) for d in rows_of(ids, places)] if prompted else [b""] * batch.num_rows
        for at, ids, places in encoder.encode(batch.column("text"), end_id):
            own = batch.column("doc_id").slice(at, len(places) - 1).to_pylist()
            for doc_id, p, a in zip(own, ahead[at : at + len(own)], rows_of(ids, places), strict=True):
                packer.add((doc_id, p + a, len(p) // 4), (len(p) + len(a)) // 4, len(p) // 4)
            if len(packer.rows) >= window:
                packer.pack()
            if done:
                yield flush()
    packer.pack(last=True)
    if done:
        yield flush()


def pack(
    spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, prompt: str | None = None,
    max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, window: int = WINDOW,
) -> DataFrame:
    """Pack every row of docs (doc_id, text) into sequences; one result row for each piece.

    A row's ids are those of its prompt column (if one is named; its tokens bear no loss), then those
    of text, then end_id. Rows may be cut; each id lies in exactly one piece. A sequence holds at
    most max_tokens tokens, max_segments pieces and max_loss loss-bearing tokens. Its length is
    max_tokens or a power of two, so nothing is padded.

    Null text or prompt counts as empty (the end id alone is left). Repeated rows and ids are packed
    each for itself. Other columns are ignored; an empty table gives an empty result.
    """
    vocabulary, limits = vocabulary or vocabulary_path(), (max_tokens, max_segments, max_loss)
    ahead = F.coalesce(docs[prompt], F.lit("")) if prompt else F.lit("")
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"), ahead.alias("prompt"))
    return rows.mapInArrow(lean(lambda it: pack_rows(it, vocabulary, end_id, limits, window, prompt is not None)), PIECE)
