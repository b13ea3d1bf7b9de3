"""Main text of web pages: markup structure, and a suffix array over each host's other text.

A page's article is its text (its main element where it has no article); what is left of it once menus,
forms, adverts, comments and the like are taken out. The page has two streams of tokens, that of its article
and that of all other visible text, and the streams of a host's pages go, one after the other, through a suffix
array that is sorted to a depth of MIN_TOKENS: Spark groups equal prefixes, so no host's array has to fit in one
task. Of the articles' suffixes only those are grouped that a filter over the other text's lets through, as others
are equal to none of these. A prefix that occurs on two distinct pages is a repeat; on a page without an article, if
both have it outside their articles, as what is another page's article is no boilerplate there. A place is covered by some repeated substring of MIN_TOKENS
or more exactly if one of its prefixes of that depth covers it, so deeper sorting would not change a result;
runs of such prefixes are the longest repeats.

What repeats cover is boilerplate and goes; unique runs stay in the text where the markup leaves it open:
blocks of an article whose class hints at, but does not say, that they are none of it; what a main element
holds beside articles; and all unmarked text of pages without an article, or with a far longer text than it.
Within the article itself nothing is removed for being repeated: copied articles are articles.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_batches, materialise, skew_join

#: Tokens that a substring must have to count as a repeat.
MIN_TOKENS = 8
#: Unmarked text of so many times the article's tokens is searched for the page's text too: such a page's article
#: element is a teaser, or its markup is broken. A choice between two readings of a page, for any page and size.
FAR_LONGER = 2
#: Binary logarithm of the bits of the filter over the runs of tokens outside articles (16 MB). Past some 20 million distinct runs
#: more than a seventh of the articles' pass it; it only saves shuffle ahead of the grouping, so results stay the same.
FILTER_BITS = 27
#: Pages whose row keys are alike but for so many bits are packed together, in rows of so many bytes of text.
PACK_BITS, PACK_BYTES = 10, 4 << 20

# Elements whose content is never text, in any place.
SILENT = set("head title script style noscript template iframe object svg canvas audio video math map form button select option datalist textarea input dialog".split())
# Elements around an article.
AROUND = set("nav footer aside menu".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
# Words in class, id or role that mark what is not article text.
MARKS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer contentinfo sidebar complementary cookie cookies consent gdpr notice banner alert "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe subscription popup modal overlay "
    "share sharing social related recommended comment comments commentlist reply replies respond disqus widget login signup search pagination pager".split()
)
# Words of layout that leave a mark's meaning as it is ("share-buttons", "cookie_bar").
LAYOUT = set(
    "area bar block body bottom box btn button buttons col column container content entry fixed footer form group head header holder inner item items label left "
    "line link links list main message outer panel panels popup region right row section slot sticky strip tab text title toggle top unit view wrap wrapper".split()
)
# Marks that are also words of ordinary articles; inside one, they say nothing beside another word.
AMBIGUOUS = set("social related recommended search alert notice banner promo promotion menu modal overlay widget reply replies respond subscription consent login signup share sharing sponsor".split())
_RAW = "script|style|noscript|template|textarea|title|svg|iframe"
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def attributes_of(tag: str) -> dict[str, str]:
    """A tag's attributes by name in lower case, the first of each; character references are decoded."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def is_hidden(attributes: dict[str, str]) -> bool:
    """Not shown: by an attribute of that name, for assistants, or by its own style; words in values say nothing."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NOT_SHOWN.search(attributes.get("style", "")))


def _marks(attributes: dict[str, str]) -> tuple[set[str], bool, bool, bool]:
    """The words of class, id and role, each whole; whether one of them says that this is no article text (a mark,
    by itself or with words of layout); whether it says so inside an article too, where ambiguous marks must
    stand alone; and whether one only hints at it (a mark with other words)."""
    whole, says, sure, hints = set(), False, False, False
    for name in ("class", "id", "role"):
        for word in attributes.get(name, "").split():
            parts = set(_WORD.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", word).lower()))
            whole.add(("role:" if name == "role" else "") + word.lower())
            if parts & MARKS:
                told = parts <= MARKS | LAYOUT or all(x.isdigit() for x in parts - MARKS - LAYOUT)
                says |= told
                sure |= parts <= MARKS or told and bool(parts & (MARKS - AMBIGUOUS))
                hints = True
    return whole, says, sure, hints


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of a page's blocks in order; place: 'article', 'main', 'doubt' (in one of these, where a
    class hints at other text), 'loose' or 'junk' (outside, and marked as such)."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # element, place of its content ('' for none)
    place, held, at = "loose", [], 0

    def end_block() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((place, text))

    for m in _TAG.finditer(page):
        if place and m.start() > at:
            held.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE and held:
            if name in ("br", "wbr") and place:
                held.append(" ")
            else:
                end_block()
        if m[2]:
            if any(name == e for e, _ in stack):
                while stack:
                    e, _ = stack.pop()
                    if e == name:
                        break
                new = stack[-1][1] if stack else "loose"
                if new != place:
                    end_block()
                    place = new
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name == "p" and any(e == "p" for e, _ in stack[-6:]):
            # A paragraph ends the one before it, and inline elements left open in it.
            cut = max(i for i, (e, _) in enumerate(stack) if e == "p")
            if all(e in INLINE or e == "p" for e, _ in stack[cut:]):
                del stack[cut:]
                place = stack[-1][1] if stack else "loose"
        new = place
        if place:
            attributes = attributes_of(m[4]) if m[4].strip() else {}
            words, says, sure, hints = _marks(attributes)
            inside = place in ("article", "main", "doubt")
            if name in SILENT or is_hidden(attributes):
                new = ""
            elif name == "article" and not words & {"comment", "comments", "reply"}:
                new = "article" if place != "junk" else "junk"
            elif name == "main" or "role:main" in words:
                new = "main" if place == "loose" else place
            elif name in ("html", "body"):
                new = place
            elif name in AROUND or (sure if inside else says) or name == "header" and not inside or not inside and words & {"header"}:
                new = "" if inside else "junk"
            elif hints and inside:
                new = "doubt"
        if new != place:
            end_block()
            place = new
        stack.append((name, place))
    if place and at < len(page):
        held.append(html.unescape(page[at:]))
    end_block()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


PARSED = "rid long, page_id long, url string, host string, page long, places array<string>, texts array<string>, stream array<string>"


def stream_of(found: list[tuple[str, str]], own: str | None) -> list[str]:
    """Tokens of the blocks outside a page's own place."""
    return [w for p, t in found if p != own for w in t.split()]


def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A page's blocks with their places, and the stream of tokens outside its own place; every page's repeats are
    looked up, also where its markup leaves little open."""
    for pdf in batches:
        rows = []
        for rid, page_id, url, page, html_ in zip(pdf["rid"], pdf["page_id"], pdf["url"], pdf["page"], pdf["html"], strict=True):
            found = blocks(html_)
            places = [p for p, _ in found]
            rows.append((rid, page_id, url, host_of(url), page, places, [t for _, t in found], stream_of(found, own_of(places))))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])
        out["page_id"] = out["page_id"].astype("Int64")
        yield out


def pack(pages: list[tuple]) -> bytes:
    """Parsed pages (rid, page_id, url, host, page, places, texts) compressed together, column by column, behind their plain size."""
    plain = json.dumps(list(zip(*pages, strict=True)), ensure_ascii=False, separators=(",", ":")).encode()
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=12).compress(plain, asbytes=True)


def unpack(packed: bytes) -> list[tuple]:
    size = int.from_bytes(packed[:8], "little")
    return list(zip(*json.loads(pa.Codec("zstd").decompress(packed[8:], decompressed_size=size, asbytes=True)), strict=True))


def pack_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parsed pages packed by the pack their key is in. A pack is cut where its text gets long, so several rows may be of it."""
    held: list[tuple] = []
    size = 0
    for pdf in parse_batches(batches):
        rows = []
        for rid, page_id, url, host, page, places, texts in pdf.drop(columns="stream").astype(object).itertuples(index=False, name=None):
            if held and (rid >> PACK_BITS != held[0][0] >> PACK_BITS or size > PACK_BYTES):
                rows.append((held[0][0] >> PACK_BITS, pack(held)))
                held, size = [], 0
            held.append((rid, None if pd.isna(page_id) else page_id, url, host, page, places, texts))
            size += sum(map(len, texts))
        yield pd.DataFrame(rows, columns=["pack", "packed"])
    if held:
        yield pd.DataFrame([(held[0][0] >> PACK_BITS, pack(held))], columns=["pack", "packed"])


def own_of(places: list[str]) -> str | None:
    """The place that is a page's article: its article elements, or else its main element, or none."""
    return "article" if "article" in places else "main" if "main" in places else None


def stream_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(rid, host, page, stream) of packed pages."""
    for pdf in batches:
        for packed in pdf["packed"]:
            rows = []
            for rid, _, _, host, page, places, texts in unpack(packed):
                rows.append((rid, host, page, stream_of(list(zip(places, texts, strict=True)), own_of(places))))
            yield pd.DataFrame(rows, columns=["rid", "host", "page", "stream"])


def runs_of(streams: list[list[str]], hosts: list[str], min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, start from 0, hash) of all runs of min_tokens tokens; equal runs of a host have equal hashes."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    n = int(sizes.sum()) - min_tokens + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    codes = pd.util.hash_array(np.array([w for s in streams for w in s], dtype=object))
    at = np.repeat(np.arange(len(sizes)), sizes)[:n]
    start = np.arange(n) - (np.cumsum(sizes) - sizes)[at]
    hashes = pd.util.hash_array(np.array(hosts, dtype=object))[at]
    for j in range(min_tokens):
        hashes = hashes * np.uint64(0x100000001B3) + codes[j : j + n]
    hashes ^= hashes >> np.uint64(32)
    whole = start + min_tokens <= sizes[at]
    return at[whole], start[whole], hashes[whole]


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The filter's bit for each hash."""
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def filter_batches(batches: Iterator[pd.DataFrame], min_tokens: int) -> Iterator[pd.DataFrame]:
    """(w, b): words of the filter over the runs outside articles."""
    for pdf in stream_batches(batches):
        bits = np.unique(bits_of(runs_of(list(pdf["stream"]), list(pdf["host"]), min_tokens)[2]))
        if len(bits):
            words, first = np.unique(bits >> np.uint64(6), return_index=True)
            yield pd.DataFrame({"w": words.astype(np.int64), "b": np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), first).view(np.int64)})


def article_batches(batches: Iterator[pd.DataFrame], table: bytes, min_tokens: int) -> Iterator[pd.DataFrame]:
    """(host, page, run) for the runs of tokens of packed pages' articles that the filter lets through."""
    held = np.frombuffer(pa.Codec("zstd").decompress(table, decompressed_size=1 << (FILTER_BITS - 3), asbytes=True), dtype=np.uint64)
    for pdf in batches:
        for packed in pdf["packed"]:
            pages = [p for p in unpack(packed) if own_of(p[5])]
            streams = [[w for p, t in zip(places, texts, strict=True) if p == own_of(places) for w in t.split()] for *_, places, texts in pages]
            at, start, hashes = runs_of(streams, [p[3] for p in pages], min_tokens)
            bits = bits_of(hashes)
            hit = (held[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)
            rows = [(pages[i][3], pages[i][4], " ".join(streams[i][k : k + min_tokens])) for i, k in zip(at[hit], start[hit], strict=True)]
            yield pd.DataFrame(rows, columns=["host", "page", "run"])


def article_runs(packed: DataFrame, min_tokens: int) -> DataFrame:
    """(prefix, page) of the suffixes in articles, but for most of those that are equal to none outside articles."""
    words = packed.select("packed").mapInPandas(lambda it: filter_batches(it, min_tokens), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    held = pa.Codec("zstd").compress(table.tobytes(), asbytes=True)  # a large closure is a file for each executor
    runs = packed.select("packed").mapInPandas(lambda it: article_batches(it, held, min_tokens), "host string, page long, run string")
    return runs.select(F.unhex(F.md5(F.concat_ws(" ", "host", "run").cast("binary"))).alias("prefix"), "page")


def suffix_array(parsed: DataFrame, articles: DataFrame, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(suffixes, repeats): every suffix (rid, page, start, prefix) of the streams outside articles, and their prefixes that two
    distinct pages of a host share, with their number; among: two share them outside articles. A prefix is the md5 of the
    host and the tokens; articles has those in articles (prefix, page)."""
    n = F.size("stream") - (min_tokens - 1)
    prefix = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("start"), F.unhex(F.md5(F.concat_ws(" ", "host", F.array_join(F.slice("stream", i, min_tokens), " ")).cast("binary"))).alias("prefix")))
    suffixes = parsed.where(n > 0).select("rid", "page", F.explode(prefix).alias("s")).select("rid", "page", "s.start", "s.prefix")
    none = F.lit(None).cast("long")
    both = suffixes.select("prefix", "page", none.alias("own")).unionAll(articles.select("prefix", none, "page"))
    equal = both.groupBy("prefix").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.min("own").alias("own_first"), F.max("own").alias("own_last"), F.count("page").alias("n"))
    return suffixes, equal.where("n > 0 and least(first, own_first) <> greatest(last, own_last)").select("prefix", "n", F.expr("first <> last").alias("among"))


def finish_page(found: list[tuple[str, str]], starts: list[int], min_tokens: int) -> str:
    """The text of a page whose stream has repeats at the starts (from 1)."""
    own = own_of([p for p, _ in found])
    covered = bytearray(len(stream_of(found, own)))
    for s in starts:
        covered[s - 1 : s - 1 + min_tokens] = b"\1" * min_tokens
    at, parts, size, loose = 0, [], 0, 0
    for p, t in found:
        if p == own:
            parts.append((p, t))
            size += len(t.split())
            continue
        words = t.split()
        left = [w for w, c in zip(words, covered[at : at + len(words)], strict=True) if not c]
        at += len(words)
        loose += len(left) if p == "loose" else 0
        parts.append((p, " ".join(left)))
    open_ = {own, "doubt", "main"} | ({"loose"} if own is None or loose > FAR_LONGER * size else set())
    return " ".join(t for p, t in parts if p in open_ and t)


def finish_batches(batches: Iterator[pd.DataFrame], min_tokens: int) -> Iterator[pd.DataFrame]:
    """Texts of packed pages; repeats are the places of their pack: a page's last bits, whether no other page but in its
    article has the run (which says nothing on a page without an article), then the start."""
    for pdf in batches:
        for packed, repeats in zip(pdf["packed"], pdf["repeats"], strict=True):
            pages = unpack(packed)
            last = (1 << PACK_BITS) - 1
            bare = {rid & last for rid, _, _, _, _, places, _ in pages if own_of(places) is None}
            starts: dict[int, list[int]] = {}
            for r in [] if repeats is None else map(int, repeats):
                if not (r >> 31 & 1 and r >> 32 in bare):
                    starts.setdefault(r >> 32, []).append(r & 0x7FFFFFFF)
            texts = [finish_page(list(zip(p, t, strict=True)), starts.get(rid & last, []), min_tokens) for rid, _, _, _, _, p, t in pages]
            yield pd.DataFrame({"page_id": pd.array([p[1] for p in pages], "Int64"), "url": [p[2] for p in pages], "text": texts})


def extract(spark: SparkSession, pages: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Character references are decoded; white space within a block becomes one space; blocks are joined
    in page order by one space. Null html counts as empty (text ''); a null url is a host of its
    own name ''; repeated rows are copies of one page, so that they are no repeats of each other; other
    columns are ignored; an empty table gives an empty result.

    Parsed pages are stored and shuffled in compressed packs of neighbouring rows; what a pack's pages repeat comes to it.
    """
    hold_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", F.xxhash64("html").alias("page"), "html")
    packed = materialise(spark, rows.mapInPandas(pack_batches, "pack long, packed binary"), "pages")
    parsed = packed.select("packed").mapInPandas(stream_batches, "rid long, host string, page long, stream array<string>")
    suffixes, repeated = suffix_array(parsed, article_runs(packed, min_tokens), min_tokens)
    repeated = materialise(spark, repeated, "repeats")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    asked = suffixes.select("rid", "start", "prefix")
    found = skew_join(asked, repeated, "prefix", "n", "rid", max(1, total)).where("n is not null")
    place = F.shiftleft(F.col("rid").bitwiseAND((1 << PACK_BITS) - 1), 32).bitwiseOR(F.col("start").cast("long")).bitwiseOR(F.when(F.col("among"), 0).otherwise(1 << 31))
    places = found.groupBy(F.shiftright("rid", PACK_BITS).alias("pack")).agg(F.collect_list(place).alias("repeats"))
    done = packed.join(places, "pack", "left").select("packed", "repeats").mapInPandas(lambda it: finish_batches(it, min_tokens), "page_id long, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
