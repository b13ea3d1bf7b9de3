"""Token counts from a byte-level BPE vocabulary that is compiled to deterministic transducers.

Two machines run one after the other. The splitter, of eight states, reads classes of characters and marks
where the words start that the vocabulary never merges across. The counter reads a word's bytes, and its
transitions carry the change of the number of tokens; it is determinised as far as the corpus goes. Text is
cut into lanes; a lane's map (state in -> state out) is composed with those before it by a parallel prefix
scan, within a task as arrays, and over the chunks of long documents as rows.

A counter's state is what may still matter of a word's beginning: each place from which some longer token
may start, as its node in the trie of tokens, the last token before that place, and how many tokens have
been added since. A prefix's last token is the one that its left neighbour's encoding goes with, which is
decided by encoding the two alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gather, lean, materialise, text_of
from .tokens import vocabulary_path

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Bytes of a chunk, of text taken at a time, and chunk maps that are composed at a time.
CHUNK_BYTES, STEP_BYTES, FAN = 1 << 16, 2 << 20, 64
#: Counter states held by a worker, and remembered pairs and rests of words; a word that leaves the states is
#: carried on byte by byte. When one word in so many does, the states are those of other text, and are made anew.
STATES, MEMO, RARE = 3 << 16, 400_000, 10
#: Characters of a lane of the splitter, and lanes of the counter below which it goes on byte by byte.
LANE, FEW = 256, 16
SHIFT, BIAS = 18, 1 << 10  # a state's number, and a change, in an entry of the counter's table
SPREAD = np.int64(0x9E3779B97F4A7C15 - (1 << 64))  # an odd multiplier that scatters keys (golden ratio)
LOW, LOWER, SINK = (1 << 18) - 1, (1 << 36) - 1, 2 | BIAS << SHIFT
# States of the splitter: a new word must start, or one of letters, of numbers, of other characters, of white
# space is open, a space that joins what follows, and one or two letters of a contraction are to come.
NEW, LETTERS, NUMBERS, OTHERS, SPACES, JOIN, ONE_MORE, TWO_MORE = range(8)
# Classes of characters, the first of the symbols.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, SPACE_INSIDE, BLANK, BLANK_INSIDE = range(9)
SYMBOLS, UNKNOWN = 9, 255
#: Endings of contractions that are words of their own (fixed values of this kind of vocabulary).
CONTRACTIONS = ["s", "t", "m", "d", "re", "ve", "ll"]


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, a word starts here) by state and symbol. Symbols from SYMBOLS on are the same ones at the
    start of a text; the last one changes nothing."""
    go, starts = np.zeros((8, 2 * SYMBOLS + 1), np.uint8), np.zeros((8, 2 * SYMBOLS + 1), bool)
    for q in range(8):
        for kind, own in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            go[q, kind], starts[q, kind] = own, q not in (own, JOIN)
        for kind, own in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            joins = q in (OTHERS, JOIN)
            go[q, kind], starts[q, kind] = OTHERS if joins else own, not joins
        go[q, SPACE], go[q, BLANK], starts[q, [SPACE, BLANK]] = JOIN, NEW, True
        go[q, [SPACE_INSIDE, BLANK_INSIDE]], starts[q, [SPACE_INSIDE, BLANK_INSIDE]] = SPACES, q != SPACES
        go[q, -1] = q
    go[TWO_MORE, LETTER], go[ONE_MORE, LETTER], starts[[ONE_MORE, TWO_MORE], LETTER] = ONE_MORE, NEW, False
    go[:, SYMBOLS:-1], starts[:, SYMBOLS:-1] = go[NEW, :SYMBOLS], True
    return go, starts


GO, STARTS = splitter()
GO_FLAT, STARTS_FLAT, WIDTH = GO.ravel(), STARTS.ravel(), GO.shape[1]


def word_starts(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """Where words start, and the state at the end; the first symbol is that of a text's start."""
    lanes = -(-len(symbols) // LANE)
    padded = np.full(lanes * LANE, WIDTH - 1, np.uint8)
    padded[: len(symbols)] = symbols
    steps = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for s in steps:
        maps = GO_FLAT.take(maps * np.int16(WIDTH) + s[:, None])
    reach = 1
    while reach < lanes:  # after each round a lane's map is that of twice as many lanes up to it
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.concatenate([[np.uint8(NEW)], maps[:-1, NEW]]).astype(np.int16)
    marks = np.empty((LANE, lanes), bool)
    for k, s in enumerate(steps):
        at = state * WIDTH + s
        marks[k] = STARTS_FLAT.take(at)
        state = GO_FLAT.take(at).astype(np.int16)
    return marks.T.ravel()[: len(symbols)], int(state[-1])


class Transducer:
    """The machines of a vocabulary file; one for each file and worker process."""

    _held: dict[str, Transducer] = {}

    @classmethod
    def of(cls, path: str) -> Transducer:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str, states: int = STATES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a byte-level BPE vocabulary")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as the character of their number
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ids = {t: i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for i, data in self.bytes_of.items():
            node = 0
            for b in data:
                key = node << 8 | b
                self.inner[node] = True
                node = self.child.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = i
        self.parts = {merged: (a, b, rank) for (a, b), (rank, merged) in sorted(self.merge.items(), key=lambda x: -x[1][0])}
        self.fit: dict[int, bool] = {}
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.most = states
        self.reset()

    def reset(self) -> None:
        """Forget the counter's states. Transitions lie in an open-addressed table by state and byte; an entry is
        the next state and one in its low SHIFT bits, and above them the change of the number of tokens and BIAS."""
        self.known = [(BIAS,), ()]  # the start, and a sink
        self.number = {self.known[0]: 0}
        self.bits = (4 * (self.most + 256) - 1).bit_length()
        self.keys, self.entries = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.filled = 0
        self.rests: dict[tuple[int, bytes], int] = {}
        for b in range(256):
            self.insert(256 + b, SINK)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return keys * SPREAD >> 64 - self.bits & len(self.keys) - 1

    def insert(self, key: int, entry: int) -> None:
        slot = int(self.slots(np.array([key]))[0])
        while self.keys[slot] >= 0:
            slot = slot + 1 & len(self.keys) - 1
        self.keys[slot], self.entries[slot] = key, entry
        self.filled += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entries of transitions; 0 for those not there."""
        slot = self.slots(keys)
        held, out = self.keys.take(slot), self.entries.take(slot)
        left = np.flatnonzero(held != keys)
        out[left] = 0
        left = left[held[left] >= 0]
        while len(left):
            at = slot[left] = slot[left] + 1 & len(self.keys) - 1
            held = self.keys[at]
            out[left] = np.where(held == keys[left], self.entries[at], 0)
            left = left[(held != keys[left]) & (held >= 0)]
        return out

    def encode(self, data: bytes) -> list[int]:
        """A word's tokens, merged pair by pair; for two tokens at most."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min((self.merge.get(pair, (1 << 40, 0)) + (k,) for k, pair in enumerate(zip(ids, ids[1:], strict=False))), key=lambda x: (x[0], x[2]))
            if best[0] == 1 << 40:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """What stands at one edge of a token while it is merged: (token, rank of the merge that ends it)."""
        ends = 1 << 40
        while True:
            yield token, ends
            if token not in self.parts:
                return
            *sides, ends = self.parts[token]
            token = sides[side]

    def fits(self, last: int, token: int) -> bool:
        """Whether token can follow last (-1: starts a word): it is its own encoding, and no merge of what stands
        at both sides of the border comes before those that build the two. Of equal pairs the left one goes first."""
        key = (last + 1) << 20 | token
        found = self.fit.get(key)
        if found is None:
            if last < 0:
                found = self.encode(self.bytes_of[token]) == [token]
            else:
                found = self.fits(-1, token)
                right = list(self._edge(token, 0))
                for a, ends_a in self._edge(last, 1) if found else ():
                    for b, ends_b in right:
                        rank = self.merge.get((a, b), (1 << 41,))[0]
                        if rank < ends_a and rank <= ends_b:
                            found = False
            self.fit[key] = found
        return found

    def step(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """The next state, and the change of the number of tokens. A place of a state is one number: its node, the
        last token before it (and one, 0 for none) and the tokens since (and BIAS)."""
        grown, found, change = [], -1, 0
        for place in state:
            child = self.child.get(place >> 36 << 8 | byte)
            if child is None:
                continue
            token = self.token_at[child]
            if found < 0 and token >= 0 and self.fits((place >> 18 & LOW) - 1, token):
                found, change = token, 1 + BIAS - (place & LOW)
            if self.inner[child]:
                grown.append(child << 36 | place & LOWER)
        return (*(place + change for place in grown), found + 1 << 18 | BIAS), change

    def compile(self, at: int) -> None:
        """Fill in a transition, if there is room for its state."""
        state, change = self.step(self.known[at >> 8], at & 255)
        number = self.number.get(state)
        if number is None:
            if len(self.known) >= self.most:
                return
            number = self.number[state] = len(self.known)
            self.known.append(state)
        if self.filled < 2 * self.most + 256:
            self.insert(at, number + 1 | change + BIAS << SHIFT)

    def count_word(self, data: bytes, state: tuple[int, ...] = (BIAS,)) -> int:
        total = 0
        for b in data:
            state, change = self.step(state, b)
            total += change
        return total

    def count_rest(self, state: int, rest: bytes) -> int:
        """What the rest of a word adds, from a state of the table."""
        found = self.rests.get((state, rest))
        if found is None:
            if len(self.rests) >= MEMO // 2:
                self.rests.clear()
            found = self.rests[state, rest] = self.count_word(rest, self.known[state])
        return found

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word of data: one step of all words that are long enough at a time."""
        if len(self.fit) > MEMO:
            self.fit.clear()
        order = np.argsort(np.uint16(65535) - np.minimum(sizes, 65535).astype(np.uint16), kind="stable")
        begin, size = starts[order], np.minimum(sizes[order], 65535)
        end = begin + sizes[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        at, left, ascending = 0, 0, size[::-1]
        while (k := len(size) - int(np.searchsorted(ascending, at, side="right"))) >= FEW:
            where = state[:k] << 8 | data.take(begin[:k] + at)
            entry = self.find(where)
            if not entry.all():
                for missing in np.unique(where[entry == 0]).tolist():
                    self.compile(missing)
                entry = self.find(where)
                full = np.flatnonzero(entry == 0)
                for i in full.tolist():
                    total[i] += self.count_rest(int(state[i]), data[begin[i] + at : end[i]].tobytes())
                entry[full] = SINK
                left += len(full)
            total[:k] += (entry >> SHIFT) - BIAS
            state[:k] = (entry & (1 << SHIFT) - 1) - 1
            at += 1
        for i in range(max(k, int(np.searchsorted(-size, -65535, side="right")))):
            if state[i] != 1 and begin[i] + at < end[i]:
                total[i] += self.count_word(data[begin[i] + at : end[i]].tobytes(), self.known[int(state[i])])
        if left * RARE > len(order):
            self.reset()
        out = np.empty_like(total)
        out[order] = total
        return out

    def symbols(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The splitter's symbols of characters; starts marks those that start a text."""
        kinds = self.kinds[codes]
        for c in np.unique(codes[kinds == UNKNOWN]).tolist():
            self.kinds[c] = self._kind(chr(c))
        kinds = self.kinds[codes]
        inside = np.append(~starts[1:], False)  # a character of the same text follows
        spaces = (kinds == SPACE) | (kinds == BLANK)
        followed = inside & ~np.append(spaces[1:], True)
        kinds = np.where(spaces & ~followed, kinds + 1, kinds)
        for i in np.flatnonzero(codes == ord("'")).tolist():
            stop = i + 1
            while stop < min(i + 3, len(codes)) and not starts[stop]:
                stop += 1
            ahead = "".join(map(chr, codes[i + 1 : stop].tolist()))
            kinds[i] = SHORT if ahead[:1] in CONTRACTIONS else LONG if ahead in CONTRACTIONS else OTHER
        return np.where(starts, kinds + SYMBOLS, kinds).astype(np.uint8)

    def _kind(self, c: str) -> int:
        """A character's class as the library has it: what it makes one word with."""
        if c == " ":
            return SPACE
        return next((kind for kind, with_ in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!")) if len(self.pieces(with_ + c)) == 1), BLANK)

    def specials(self, data: bytes) -> list[tuple[int, int]]:
        """Places of special tokens: leftmost, the longest of those that start together."""
        if not any(s in data for s in self.special):
            return []
        found = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        return [m.span() for m in found.finditer(data)]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Words of texts that lie one after another in data: their starts, sizes and counts, the text each
        belongs to, and the splitter's state at the end."""
        raw = data.tobytes()
        spans = [s for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for s in ((x + a, y + a) for x, y in self.specials(raw[a:b]))] if any(s in raw for s in self.special) else []
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        if not len(codes):
            none = np.zeros(0, np.int64)
            return none, none, none, none, NEW
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True
        for a, b in spans:
            starts[[a, b]] = True
        starts = starts[:-1][lead]
        symbols = self.symbols(codes, starts)
        for a, b in spans:
            inside = slice(*np.searchsorted(lead, [a, b]))
            symbols[inside] = np.where(starts[inside], LETTER + SYMBOLS, LETTER)
        marks, state = word_starts(symbols)
        begin = lead[marks]
        sizes = np.diff(np.append(begin, len(data)))
        counts = self.count(data, begin, sizes)
        if spans:
            counts[np.isin(begin, [a for a, _ in spans])] = 1
        return begin, sizes, counts, np.searchsorted(offsets, begin, side="right") - 1, state

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each of the texts (binary)."""
        out = []
        rows = max(1, int(len(texts) * min(1.0, STEP_BYTES / max(1, texts.nbytes))))
        for at in range(0, len(texts), rows):
            own = texts.slice(at, rows)
            offsets = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4).astype(np.int64)
            data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            _, _, counts, text, _ = self.texts(data, offsets - offsets[0])
            out.append(np.bincount(text, counts, minlength=len(own)).astype(np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def chunk_map(self, before: bytes, own: bytes, after: bytes, first: bool) -> list[dict]:
        """What a chunk does from each of the splitter's states: the bytes that end the word open before it,
        whether a word starts in it at all, the tokens of words that start and end in it, the bytes of the
        word that is open at its end, and the state there.

        A chunk has its own bytes, but for a character or special token that started before it, which is
        left to the chunk of its first byte.
        """
        context = before + own + after
        spans = self.specials(context)

        def whole(at: int) -> int:
            at = next((b for a, b in spans if a < at < b), at)
            while at < len(context) and context[at] & 0xC0 == 0x80:
                at += 1
            return at

        a, b = whole(len(before)), whole(len(before) + len(own))
        raw = context[a:b]
        ahead = np.frombuffer(context[a:].decode(errors="ignore").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((np.frombuffer(context[a:], np.uint8) & 0xC0) != 0x80)[: len(ahead)]
        marked = [x - a for span in spans for x in span]
        starts = np.isin(lead, marked + [0] * (first or any(y == a for _, y in spans)))
        inside = lead < len(raw)
        symbols = self.symbols(ahead, starts)
        for x, y in spans:
            symbols[(lead > x - a) & (lead < y - a)] = LETTER
            symbols[lead == x - a] = LETTER + SYMBOLS
        symbols, lead, special = symbols[inside], lead[inside], {x - a for x, _ in spans}
        states, opens, at = list(range(8)), [[] for _ in range(8)], 0
        while at < len(symbols):  # up to where a word starts whatever came before
            s = symbols[at]
            if STARTS[states, s].all():
                break
            for q in range(8):
                if STARTS[states[q], s]:
                    opens[q].append(int(lead[at]))
                states[q] = int(GO[states[q], s])
            at += 1
        inner, tail, cut = 0, b"", int(lead[at]) if at < len(symbols) else len(raw)
        synced = at < len(symbols)
        if synced:
            rest = symbols[at:].copy()
            rest[0] = rest[0] % SYMBOLS + SYMBOLS
            marks, end = word_starts(rest)
            begin = lead[at:][marks] - cut
            data = np.frombuffer(raw[cut:], np.uint8)
            counts = self.count(data, begin[:-1], np.diff(begin))
            counts[[x in special for x in (begin[:-1] + cut).tolist()]] = 1
            inner, tail = int(counts.sum()), raw[cut + int(begin[-1]) :]
            if cut + int(begin[-1]) in special:  # it is whole, and nothing joins it
                inner, tail, end = inner + 1, b"", NEW
        out = []
        for q in range(8):
            o = [*opens[q], cut] if synced else opens[q]
            got = {"prefix": raw[: o[0]] if o else raw, "closed": bool(o), "inner": 0, "tail": b"", "end": states[q]}
            got["inner"] = sum(self.count_word(raw[x:y]) for x, y in zip(o, o[1:], strict=False))
            if synced:
                got |= {"inner": got["inner"] + inner, "tail": tail, "end": end}
            elif o:
                got["tail"] = raw[o[-1] :]
            out.append(got)
        return out

    def compose(self, left: list[dict], right: list[dict]) -> list[dict]:
        """The map of two chunks in a row."""
        out = []
        for one in left:
            two = right[one["end"]]
            if not two["closed"]:
                grows = "tail" if one["closed"] else "prefix"
                out.append({**one, grows: one[grows] + two["prefix"], "end": two["end"]})
            elif not one["closed"]:
                out.append({**two, "prefix": one["prefix"] + two["prefix"]})
            else:
                out.append({**two, "prefix": one["prefix"], "inner": one["inner"] + self.count_word(one["tail"] + two["prefix"]) + two["inner"]})
        return out


MAP = "array<struct<prefix: binary, closed: boolean, inner: long, tail: binary, end: int>>"
ROW = f"row long, doc_id long, n_bytes long, k long, chunks long, n_tokens long, map {MAP}"
MAP_ARROW = pa.list_(pa.struct([("prefix", pa.binary()), ("closed", pa.bool_()), ("inner", pa.int64()), ("tail", pa.binary()), ("end", pa.int32())]))


def _read_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(path)
        for batch in gather(batches):
            alone = np.array(batch.column("chunks")) == 1
            counts = np.zeros(batch.num_rows, np.int64)
            counts[alone] = machine.whole(batch.column("own").filter(pa.array(alone)))
            maps: list = [None] * batch.num_rows
            for i in np.flatnonzero(~alone).tolist():
                before, own, after = (batch.column(c)[i].as_py() for c in ("before", "own", "after"))
                maps[i] = machine.chunk_map(before, own, after, batch.column("k")[i].as_py() == 0)
            own_columns = [batch.column(c) for c in ("row", "doc_id", "n_bytes", "k", "chunks")]
            yield pa.RecordBatch.from_arrays([*own_columns, pa.array(counts, mask=~alone), pa.array(maps, MAP_ARROW)], ["row", "doc_id", "n_bytes", "k", "chunks", "n_tokens", "map"])

    return run


def _composed(path: str, fan: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        machine, rows = Transducer.of(path), group.sort_values("k")
        out = None
        for one in rows["map"]:
            one = [{k: m[k] for k in ("prefix", "closed", "inner", "tail", "end")} for m in one]
            out = one if out is None else machine.compose(out, one)
        head = rows.iloc[0]
        chunks = -(-int(head["chunks"]) // fan)
        total = out[NEW]["inner"] + machine.count_word(out[NEW]["tail"]) if chunks == 1 else None
        made = pa.table({"row": [int(head["row"])], "k": [int(head["k"]) // fan], "chunks": [chunks], "n_tokens": pa.array([total], pa.int64()), "map": pa.array([out], MAP_ARROW)})
        return made.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return run


def token_counts(
    spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of the whole text of each row of docs.

    vocabulary is a byte-level BPE file of the tokenizers library; special tokens that a text spells out
    count as one, as is its default. Null text counts as empty and has no tokens. Rows that share an id, or
    have none, each give a row. Texts of more than chunk_bytes are cut, and their chunks' maps composed,
    fan at a time. An empty table gives no rows; other columns are ignored.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    reach = max((len(t["content"].encode()) for t in _added(path)), default=1)
    rows = text_of(docs, docs["doc_id"].cast("long").alias("doc_id")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_bytes") / chunk_bytes).cast("long"))

    def piece(start, size):
        return F.substring(F.col("text"), (start + 1).cast("int"), size.cast("int"))

    def chunk(k):
        start = k * chunk_bytes
        back = F.least(start, F.lit(reach - 1).cast("long"))
        return F.struct(k.alias("k"), piece(start - back, back).alias("before"), piece(start, F.lit(chunk_bytes)).alias("own"), piece(start + chunk_bytes, F.lit(reach + 8)).alias("after"))

    chunks = rows.withColumn("chunks", n).select("row", "doc_id", "n_bytes", "chunks", F.inline(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), chunk)))
    read = materialise(spark, chunks.mapInArrow(lean(_read_chunks(path)), ROW), "token-counts")
    done = read.where("chunks = 1").select("doc_id", "n_bytes", "n_tokens")
    most = read.agg(F.max("chunks")).first()[0] or 1
    if most > 1:
        about = read.where("chunks > 1 and k = 0").select("row", "doc_id", "n_bytes")
        left, schema = read.where("chunks > 1").select("row", "k", "chunks", "map"), f"row long, k long, chunks long, n_tokens long, map {MAP}"
        while most > 1:
            left = materialise(spark, left.withColumn("at", F.floor(F.col("k") / fan)).groupBy("row", "at").applyInPandas(_composed(path, fan), schema), "chunk-maps")
            done = done.unionByName(left.where("chunks = 1").join(about, "row").select("doc_id", "n_bytes", "n_tokens"))
            left, most = left.where("chunks > 1").select("row", "k", "chunks", "map"), -(-most // fan)
    return done.withColumn("over_limit", F.col("n_tokens") > limit)


def _added(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["added_tokens"]
