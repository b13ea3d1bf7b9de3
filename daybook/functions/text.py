"""Text expressions: accent folding, tokens, link targets, snippets. JVM-side column functions.

String lengths count code points.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "[̀-ͯ]"
MIN_PREFIX = 4
COVER_MIN_CHARS, COVER_MIN_TOKENS = 3, 2
ELLIPSIS = "…"


def fold_text(s: str) -> str:
    """Without combining accents, đ as d, lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", s)) if not 0x300 <= ord(c) <= 0x36F)
    return plain.replace("đ", "d").replace("Đ", "D").lower()


@lru_cache(maxsize=1)
def _fold_map() -> tuple[str, str]:
    """Characters of the basic plane whose accents fold away to one other character."""
    source, target = [], []
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        folded = fold_text(c)
        if len(folded) == 1 and folded != c.lower() and not 0xD800 <= cp < 0xE000:
            source.append(c)
            target.append(folded)
    return "".join(source), "".join(target)


def fold(c: Column) -> Column:
    """fold_text as an expression. Composed and decomposed spellings of a letter fold alike, as the marks
    go either way (decomposing what was composed first gives what decomposing at once does). Characters
    that fold to several are left as they are; of Hangul, for one, both spellings should be stored composed."""
    source, target = _fold_map()
    return F.lower(F.translate(F.regexp_replace(c, MARKS, ""), source, target))


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(query: str | None) -> list[str]:
    return [fold_text(t) for t in re.split(r"[\W_]+", unicodedata.normalize("NFC", query or "")) if fold_text(t)]


def trim(c: Column) -> Column:
    """Strips all Unicode white space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^[\s﻿]+", ""), r"(?U)[\s﻿]+$", "")


def link_target(c: Column) -> Column:
    """What a wiki link points at: the part ahead of a pipe, trimmed."""
    return trim(F.substring_index(c, "|", 1))


def wikilinks(c: Column) -> Column:
    """Distinct link targets in order, outside code."""
    prose = F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```|~~~.*?~~~", ""), "`[^`\n]*`", "")
    found = F.transform(F.regexp_extract_all(prose, F.lit(r"\[\[([^\[\]]+?)\]\]"), F.lit(1)), link_target)
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def hashtags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"#(?<![\p{L}\p{N}_#/]#)(\p{L}[\p{L}\p{N}_]*)"), F.lit(1)))


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(ELLIPSIS))).otherwise(c)


def content_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != "")


def first_line(c: Column, most: int) -> Column:
    return cut(F.coalesce(F.try_element_at(content_lines(c), F.lit(1)), F.lit("")), most)


def snippet(c: Column, most: int = 280) -> Column:
    return cut(F.array_join(F.slice(content_lines(c), 1, 2), " "), most)


def block_hash(c: Column) -> Column:
    return F.substring(F.sha2(trim(c), 256), 1, 16)


def unlinked(c: Column) -> Column:
    """Links replaced by what they show."""
    return F.regexp_replace(F.regexp_replace(c, r"\[\[[^\[\]|]+\|([^\[\]]+)\]\]", "$1"), r"\[\[([^\[\]]+)\]\]", "$1")


def round_up(c: Column, digits: int) -> Column:
    """Rounds halves towards positive infinity."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def coverage_rule(query: list[str]) -> tuple[list[int], int]:
    """The places of the query tokens that count for coverage (repeats count again), and how many a text
    must have. Tokens of three characters and more count; if there are none, all do."""
    long = [len(t) >= COVER_MIN_CHARS for t in query]
    counted = [i for i, _ in enumerate(query) if long[i] or not any(long)]
    return counted, max(1, min(COVER_MIN_TOKENS, len(counted) or 1))


# Folded phrases and words that ask for the current state.
NOW_PHRASES = ["hien tai", "bay gio", "hien nay", "now", "currently", "current"]
NOW_WORDS = ["dang", "now", "currently", "current"]


def asks_for_now(query: str | None) -> bool:
    folded = fold_text(query or "")
    return any(p in folded for p in NOW_PHRASES) or any(t in NOW_WORDS for t in query_tokens(query))

