"""Whole-text tokenization with a published vocabulary file.

The vocabulary lower-cases, drops white space and never merges across it, so a text's ids are those of
its words one after another. A word of Latin letters with marks behind it is the letters' ids and the marks' ids.
Such runs of letters and of marks, and words of another form, are encoded by the library once and
remembered; words and texts are put together from the remembered bytes as arrays.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Runs and words remembered by a Python worker (in each of two generations), and the longest that is.
MEMO_WORDS, MEMO_CHARS = 200_000, 40
#: Text whose distinct words are looked up together, and rows that are put together at a time.
DISTINCT_BYTES, SLICE = 16 << 20, 500
#: Letters, then ASCII marks but apostrophes (which the vocabulary joins to letters). These letters
#: are composed, and have one lower-case letter each.
LETTERS_MARKS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """encode(texts) -> their ids as little-endian unsigned 32-bit integers."""

    _held: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {"": b""}  # runs of letters, runs of marks, and other words
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a run
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each file and worker process."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _encode_runs(self, runs: list[str]) -> Iterator[bytes]:
        """Ids of runs of letters and of marks; many go to the library as one text, cut where ids end a run."""
        step = 400
        texts = [" ".join(runs[i : i + step]) for i in range(0, len(runs), step)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            here = runs[k * step : (k + 1) * step]
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(here):
                data = ids.tobytes()
                yield from (data[at:cut] for at, cut in zip([0, *cuts], cuts, strict=False))
            else:  # a run was cut otherwise: each for itself
                yield from self._encode_each(here)

    def _encode_each(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, dtype="<u4").tobytes()

    def _look_up(self, words: list[str], encode: Callable[[list[str]], Iterator[bytes]]) -> pa.Array:
        """Ids of distinct words, from memory where it has them."""
        out = list(map(self.memo.get, words))
        missing = [k for k, b in enumerate(out) if b is None]
        if missing:
            for k in missing:
                out[k] = self.older.get(words[k])
            fresh = [k for k in missing if out[k] is None]
            for k, b in zip(fresh, encode([words[k] for k in fresh]), strict=True):
                out[k] = b
            self.memo.update((words[k], out[k]) for k in missing if len(words[k]) <= MEMO_CHARS)
        return pa.array(out, pa.large_binary())

    def _words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct words: an array of bytes, and each word's place in it."""
        parts = pc.extract_regex(words, LETTERS_MARKS)
        split = pc.and_(parts.is_valid(), pc.less_equal(pc.utf8_length(words), MEMO_CHARS))
        own = words.filter(pc.invert(split))
        parts = parts.filter(split)
        letters, marks = pc.utf8_lower(parts.field("letters")).dictionary_encode(), parts.field("marks").dictionary_encode()
        both = (
            self._look_up(run.dictionary.to_pylist(), self._encode_runs).take(run.indices) for run in (letters, marks)
        )
        table = pa.concat_arrays([pc.binary_join_element_wise(*both, pa.scalar(b"", pa.large_binary())), self._look_up(own.to_pylist(), self._encode_each)])
        if len(self.memo) > MEMO_WORDS:  # what isn't met again until the next time goes
            self.older, self.memo = self.memo, {"": b""}
        split, place = split.to_numpy(zero_copy_only=False), np.empty(len(words), np.int64)
        place[split] = np.arange(len(parts))
        place[~split] = np.arange(len(parts), len(words))
        return table, place

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (row, ids, places) for slices of texts: the first row, all its rows' ids one after
        another (each followed by end, if given), and the places where rows start and the last one ends.

        Words are split, numbered and put together again as arrays; Python sees the distinct words of
        DISTINCT_BYTES of text only. A slice has SLICE rows at most.
        """
        rows = max(1, int(len(texts) * min(1.0, DISTINCT_BYTES / max(1, texts.nbytes))))
        for at in range(0, len(texts), rows):
            own = texts.slice(at, rows)
            # ASCII lower case does not change ids, except that a special token's name could appear.
            low = pc.if_else(pc.match_substring(own, "<|"), own, pc.ascii_lower(own))
            lists = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
            places = lists.offsets.to_numpy().astype(np.int64)
            places -= places[0]
            coded = lists.flatten().dictionary_encode()
            table, place = self._words(coded.dictionary)
            if end is not None:  # one more word, behind each row's own
                table = pa.concat_arrays([table, pa.array([np.uint32(end).astype("<u4").tobytes()], pa.large_binary())])
            index = place[coded.indices.to_numpy()]
            for k in range(0, len(own), SLICE):
                here = places[k : k + SLICE + 1]
                words, here = index[here[0] : here[-1]], here - here[0]
                if end is not None:
                    words, here = np.insert(words, here[1:], len(table) - 1), here + np.arange(len(here))
                got = table.take(pa.array(words))
                _, bounds, data = got.buffers()
                bounds = np.frombuffer(bounds, np.int64, len(words) + 1) // 4 if len(words) else np.zeros(1, np.int64)
                ids = np.frombuffer(data, "<u4", bounds[-1]) if bounds[-1] else np.zeros(0, "<u4")
                yield at + k, ids, bounds[here]
