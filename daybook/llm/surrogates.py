"""Personal data: detected entities get keyed surrogates of the same type, format, script and gender.

A surrogate depends on the key and the entity alone, so an entity has one surrogate in all documents
(coreference). A name that some document gives with a title is a person in all documents: its bare and
partial mentions there get the same surrogate. All entities of a format (the letters and digits of an email, the
digits of a card or telephone number, an address's network) are numbered, and a keyed permutation of these
numbers that leaves none in its place gives the surrogates: they are distinct however many entities of the
format there are. Names have no such numbering: rounds of collision checks over all distinct names give
different names different surrogates, and none that is another name of the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prune_filter, skew_join, text_of

KINDS = ["email", "card", "phone", "ip", "name", "national", "iban"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
CARD = re.compile(r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d])")
#: Cards of 15 and 14 digits, and unbroken ones of 13 and 19; these count where the check digit is right.
CARD_OTHER = re.compile(r"(?<![\d.])(?:3[47]\d{2}([ -]?)\d{6}\1\d{5}|3[0689]\d{2}([ -]?)\d{6}\2\d{4}|4\d{12}|[3-6]\d{18})(?!\d)")
NATIONAL = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Ten unbroken digits that can be a telephone number of the North American plan.
PHONE_TEN = re.compile(r"(?<![\w.+-])[2-9]\d{2}[2-9]\d{6}(?![\w-])")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)")
#: National forms with a leading zero: an area code and two groups, or five pairs.
PHONE_ZERO = re.compile(r"(?<![\w.+-])(?:0\d{2,4}[ -]\d{3,4}[ -]\d{4}|0[1-9](?:[ .-]\d{2}){4})(?![\w-]|[ .-]\d{2}(?!\d))")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4}|(?<=::))(?!\w)")
# Titles, with the gender they tell ('f', 'm' or '' for either) and the script of the name.
TITLES = [
    ("Mrs.", "f"), ("Mrs", "f"), ("Ms.", "f"), ("Ms", "f"), ("Miss", "f"), ("Mr.", "m"), ("Mr", "m"), ("Dr.", ""), ("Prof.", ""), ("Professor", ""),
    ("Frau", "f"), ("Herr", "m"), ("Herrn", "m"), ("Madame", "f"), ("Mme", "f"), ("Monsieur", "m"), ("Señora", "f"), ("Señor", "m"),
    ("Госпожа", "f"), ("Господин", "m"), ("Κυρία", "f"), ("Κύριος", "m"),
]
_GENDER = dict(TITLES)
NAME = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t, _ in sorted(TITLES, key=lambda t: -len(t[0]))) + r")(?!\w)[  ]+([^\W\d_a-zß-öø-ÿа-я]\w+(?:[ -][^\W\d_a-zß-öø-ÿа-я]\w+)?)(?!\w)")
# Syllables of surrogate names by script, and endings by script and gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta to va ve".split(),
    "cyrillic": "ба бе бо да де до фа фе га ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та то ва ве".split(),
    "greek": "βα βε βο δα δε δο φα φε γα κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα το ζα ζε".split(),
}
ENDINGS = {
    ("latin", "f"): "lia", ("latin", "m"): "ric", ("latin", ""): "len",
    ("cyrillic", "f"): "лия", ("cyrillic", "m"): "рик", ("cyrillic", ""): "лен",
    ("greek", "f"): "λια", ("greek", "m"): "ρικ", ("greek", ""): "λεν",
}
ENTITY = "kind string, entity string"


_WORD = re.compile(r"\w+")


def find_names(text: str, known: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str]]:
    """(start, end, entities, gender) of the names after a title, and of every further mention in the text
    of such a name, its surname or its first name. known: names ('first last', folded) that other
    documents give with a title; where the text has one of them whole, it counts as if it had a title.

    Entities are 'first:' with the whole name and 'last:' with the surname, one to a line: a person's
    mentions share them, whatever the title. A name of one word is a surname, unless the text has it as a
    first name only.
    """
    titled = list(NAME.finditer(text))
    people, firsts, lasts = set(), {}, set()
    for m in titled:
        words = re.split("[ -]", m[2].casefold())
        if len(words) == 2:
            people.add(tuple(words))
            firsts.setdefault(words[0], f"first:{words[0]} {words[1]}")
            lasts.add(words[1])
    for m in known:
        first, last = m.split(" ")
        people.add((first, last))
        firsts.setdefault(first, f"first:{first} {last}")
        lasts.add(last)
    lasts |= {w for m in titled if (w := m[2].casefold()).isalnum() and w not in firsts}

    def entities(words: list[str]) -> str | None:
        if len(words) == 2:
            return f"first:{words[0]} {words[1]}\nlast:{words[1]}" if tuple(words) in people else None
        return f"last:{words[0]}" if words[0] in lasts else firsts.get(words[0])

    out = [(m.start(2), m.end(2), entities(re.split("[ -]", m[2].casefold())) or f"last:{m[2].casefold()}", _GENDER[m[1]]) for m in titled]
    words = [m for m in _WORD.finditer(text) if not m[0][0].islower()] if titled or known else []
    for m, after in zip(words, [*words[1:], None], strict=True):
        if after and after.start() == m.end() + 1 and text[m.end()] in " -\xa0" and (e := entities([m[0].casefold(), after[0].casefold()])):
            out.append((m.start(), after.end(), e, ""))
        elif e := entities([m[0].casefold()]):
            out.append((m.start(), m.end(), e, ""))
    return out


_PAIR = re.compile(r"(?=(?<!\w)([^\W\d_a-zß-öø-ÿа-я]\w+)[ \xa0-]([^\W\d_a-zß-öø-ÿа-я]\w+)(?!\w))")


def capital_pairs(text: str) -> set[str]:
    """Two capitalised words in a row, folded: what could be a name."""
    return {f"{m[1]} {m[2]}".casefold() for m in _PAIR.finditer(text)}


def iban_sum(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def find_entities(text: str, known: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical form, gender), leftmost first, not overlapping; earlier kinds win ties.

    The canonical form of a name is its entities, one to a line; gender is what a name's title tells.
    """
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), 0, m[0].lower(), "") for m in EMAIL.finditer(text)]
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), 1, re.sub(r"\D", "", m[0]), "") for m in CARD.finditer(text)]
        found += [(m.start(), m.end(), 1, c, "") for m in CARD_OTHER.finditer(text) if luhn_sum(c := re.sub(r"\D", "", m[0])) % 10 == 0]
        found += [(m.start(), m.end(), 2, re.sub(r"[^\d+]", "", m[0]), "") for m in PHONE.finditer(text)]
        found += [(m.start(), m.end(), 2, re.sub(r"\D", "", m[0]), "") for m in PHONE_ZERO.finditer(text)]
        found += [(m.start(), m.end(), 2, m[0], "") for m in PHONE_TEN.finditer(text)]
        found += [(m.start(), m.end(), 5, m[0].replace("-", ""), "") for m in NATIONAL.finditer(text)]
        found += [(m.start(), m.end(), 6, c, "") for m in IBAN.finditer(text) if 15 <= len(c := m[0].replace(" ", "")) <= 34 and iban_sum(c) == 1]
        found += [(m.start(), m.end(), 3, str(ipaddress.ip_address(".".join(str(int(x)) for x in m[0].split(".")))), "") for m in IP.finditer(text)]
    if text.count(":") > 1:
        found += [(m.start(), m.end(), 3, c, "") for m in IP6.finditer(text) if (c := ip6(m[0]))]
    if known or any(t in text for t, _ in TITLES):
        found += [(a, b, 4, c, g) for a, b, c, g in find_names(text, known)]
    out: list[tuple[int, int, str, str, str]] = []
    for a, b, k, c, g in sorted(found, key=lambda s: (s[0], s[2], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, KINDS[k], c, g))
    return out


def ip6(found: str) -> str | None:
    """The short form of an IPv6 address; none for '::', which tells nobody's."""
    try:
        return None if found == "::" else str(ipaddress.IPv6Address(found))
    except ValueError:
        return None


def parts_of(kind: str, canonical: str) -> list[str]:
    return canonical.split("\n") if kind == "name" else [canonical]


_DIGITS = re.compile(r"\d[\d.() -]{6}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}")


class Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.held = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 8:
            self.held += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        v, self.held = int.from_bytes(self.held[:8], "big"), self.held[8:]
        return v % n


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))


def script_of(name: str) -> str:
    return "greek" if re.search("[Ͱ-Ͽ]", name) else "cyrillic" if re.search("[Ѐ-ӿ]", name) else "latin"


class Permutation:
    """A keyed permutation of range(n), all of it one cycle: no number stays in its place (unless it is alone).

    A Feistel network on an even number of bits, walked until it is back below n, is a permutation P; the
    cycle x -> x + 1 is seen through it.
    """

    def __init__(self, key: bytes, label: str, n: int, rounds: int = 6):
        self.n, self.rounds = n, rounds
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.seed = hmac.new(key, label.encode(), hashlib.sha256).digest()

    def _mix(self, r: int, x: int) -> int:
        size = (self.half + 7) // 8
        mixed = hashlib.shake_256(self.seed + bytes([r]) + x.to_bytes(size, "big")).digest(size)
        return int.from_bytes(mixed, "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, rounds: range, back: bool) -> int:
        while True:
            a, b = x >> self.half, x & ((1 << self.half) - 1)
            for r in rounds:
                a, b = (b ^ self._mix(r, a), a) if back else (b, a ^ self._mix(r, b))
            x = a << self.half | b
            if x < self.n:
                return x

    def move(self, x: int) -> int:
        y = (self._walk(x, range(self.rounds), back=False) + 1) % self.n
        return self._walk(y, range(self.rounds - 1, -1, -1), back=True)


def permuted(key: bytes, kind: str, text: str, label: str = "") -> str:
    """text with its ASCII letters and digits replaced by others of the same class: one permutation for all texts
    of the same classes, case, length and label."""
    base = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
    shape_ = "".join("a" if "a" <= c <= "z" else "A" if c.isalpha() else "0" if c.isdigit() else c for c in text)
    number = size = 0
    for c, n in zip(text, base, strict=True):
        number = number * n + (ord(c.lower()) - 97 if n == 26 else int(c) if n == 10 else 0)
    size = 26 ** base.count(26) * 10 ** base.count(10)
    number, out = Permutation(key, f"{kind}\0{label}\0{shape_}", size).move(number), []
    for c, n in zip(reversed(text), reversed(base), strict=True):
        number, d = divmod(number, n)
        out.append(c if n == 1 else str(d) if n == 10 else chr((97 if c.islower() else 65) + d))
    return "".join(reversed(out))


def _address(key: bytes, entity: str) -> str:
    """An address of the same version and network: of the same first octets where it is private, else of the
    same head (IPv6) or none (IPv4), and private or not as before."""
    own = ipaddress.ip_address(entity)
    number, bits = int(own), 32 if own.version == 4 else 128
    if own.version == 6:
        if own.is_private and not re.match("f[cd]|fe[89ab]", own.exploded):
            mixed = hmac.new(key, f"ip\0{entity}".encode(), hashlib.sha256).digest()
            return str(ipaddress.IPv6Address(b"\xfd" + mixed[:15]))
        fixed = 16
    else:
        fixed = (8 if number >> 24 in (10, 127) else 16) if own.is_private else 0
    free = bits - fixed
    network, number = number >> free, number & ((1 << free) - 1)
    permutation = Permutation(key, f"ip\0{own.version}\0{fixed}\0{network}", 1 << free)
    while True:
        number = permutation.move(number)
        made = type(own)(network << free | number)
        if made.is_private == own.is_private:
            return str(made)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, gender: str = "") -> str:
    """Canonical surrogate of a canonical entity. attempt and gender are those of a name's part; others have none."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, _, rest = domain.partition(".")
        known = rest in ("com", "net", "org")
        # What else a domain has is told apart by a label of its own.
        tag = "" if known else base64.b32encode(hmac.new(key, f"domain\0{rest}".encode(), hashlib.sha256).digest()[:10]).decode().lower() + "."
        return permuted(key, kind, f"{local}@{host}") + f".{tag}example." + (rest if known else "com")
    if kind == "card":
        fixed, body, check = 1 if len(entity) == 16 else 2, entity[:-1], -luhn_sum(entity[:-1] + "0") % 10
        off = (int(entity[-1]) - check) % 10  # 0 where the check digit is right
        made = entity[:fixed] + permuted(key, kind, body[fixed:], f"{entity[:fixed]} {off}")
        return made + str((-luhn_sum(made + "0") + off) % 10)
    if kind == "phone":
        code = len(entity) - 10 if entity.startswith("+") and len(entity) > 10 else 2 if entity.startswith("+") else 0
        return entity[:code] + permuted(key, kind, entity[code:], entity[:code])
    if kind == "national":
        area, group, serial = int(entity[:3]), int(entity[3:5]), int(entity[5:])
        number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        number, serial = divmod(Permutation(key, kind, 898 * 99 * 9999).move(number), 9999)
        area, group = divmod(number, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}{group + 1:02d}{serial + 1:04d}"
    if kind == "iban":
        body = permuted(key, kind, entity[4:], entity[:2])
        return f"{entity[:2]}{98 - iban_sum(entity[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        return _address(key, entity)
    s = Stream(key, kind, entity, attempt)
    role, _, name = entity.partition(":")
    script = script_of(name)
    # Later attempts are longer: three syllables alone would not do for a corpus of many names.
    stem = "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(3 + attempt))
    return f"{role}:{stem}{ENDINGS[script, gender if role == 'first' else '']}"


def shape(kind: str, found: str, canonical: str) -> str:
    """The surrogate in the written form of what was found: its separators, case and spacing."""
    if kind in ("card", "phone"):
        digits = iter(canonical.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in found)
    if kind in ("national", "iban"):
        signs = iter(canonical)
        return "".join(next(signs) if c.isalnum() else c for c in found)
    if kind == "name":
        name = " ".join(p.partition(":")[2].capitalize() for p in canonical.split("\n"))
        return name.upper() if found.isupper() and len(found) > 1 else name.replace(" ", "-") if "-" in found else name
    if kind == "email":
        return canonical.upper() if found.isupper() else canonical
    return canonical


def distinct_entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, entity, gender) of a batch, each once. Names of other documents have entities already."""
    for pdf in batches:
        found = {(k, e, g if e.startswith("first:") else "") for text in pdf["text"] for _, _, k, c, g in find_entities(text) for e in parts_of(k, c)}
        yield pd.DataFrame(list(found), columns=["kind", "entity", "gender"])


def collisions(spark: SparkSession, entities: DataFrame, key: bytes, attempts: int = 20) -> DataFrame:
    """(kind, entity, attempt, gender) for names whose first surrogate was taken or that have a gender; most
    corpora have none or few.

    Each round keeps the least entity of every surrogate and gives the others another attempt; a
    surrogate that is itself an entity of the corpus is never kept.
    """

    def made(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                yield pdf.assign(made=[surrogate(key, *x) for x in zip(pdf["kind"], pdf["entity"], pdf["attempt"], pdf["gender"], strict=True)])

        return pairs.select("kind", "entity", "attempt", "gender").mapInPandas(run, ENTITY + ", attempt int, gender string, made string")

    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(""))

    now = materialise(spark, made(entities.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(attempts):
        best = now.groupBy("kind", "made").agg(F.min("entity").alias("first"), F.count("*").alias("n"))
        real = entities.select("kind", F.col("entity").alias("made"), F.lit(True).alias("real"))
        taken = best.join(real, ["kind", "made"], "left").where("n > 1 or real").select("kind", "made", "first", "real")
        taken = materialise(spark, taken, "taken")
        if not taken.limit(1).count():
            break
        marked = now.join(taken, ["kind", "made"], "left")
        again = F.col("first").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("first") != F.col("entity")))
        moved = marked.where(again).select("kind", "entity", (F.col("attempt") + 1).alias("attempt"), "gender")
        now = materialise(spark, marked.where(~again).select("kind", "entity", "attempt", "gender", "made").unionByName(made(moved)), "surrogates")
    else:
        raise RuntimeError(f"surrogates still collide after {attempts} attempts")
    return materialise(spark, now.where("attempt > 0 or gender <> ''").select("kind", "entity", "attempt", "gender"), "attempts")


REPLACED = "doc_id long, text string, n_entities long, n_email long, n_card long, n_phone long, n_ip long, n_name long, n_national long, n_iban long, spans string"


def replace_batches(batches: Iterator[pd.DataFrame], key: bytes) -> Iterator[pd.DataFrame]:
    memo: dict[tuple[str, str, int, str], str] = {}
    for pdf in batches:
        rows = []
        for doc_id, text, others, known in zip(pdf["doc_id"], pdf["text"], pdf["others"], pdf["known"], strict=True):
            tries = {} if others is None else {(o["kind"], o["entity"]): (o["attempt"], o["gender"]) for o in others}
            found, parts, at = find_entities(text, frozenset(() if known is None else known)), [], 0
            for a, b, kind, canonical, _ in found:
                made = []
                for entity in parts_of(kind, canonical):
                    k = (kind, entity, *tries.get((kind, entity), (0, "")))
                    if k not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[k] = surrogate(key, *k)
                    made.append(memo[k])
                parts += [text[at:a], shape(kind, text[a:b], "\n".join(made))]
                at = b
            kinds = [k for _, _, k, *_ in found]
            rows.append((doc_id, "".join(parts) + text[at:], len(found), *(kinds.count(k) for k in KINDS), ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in found)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in REPLACED.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


OTHERS = "array<struct<kind:string,entity:string,attempt:int,gender:string>>"


def names_elsewhere(spark: SparkSession, numbered: DataFrame, people: DataFrame) -> DataFrame:
    """(rid, known): for each document, the names it has that some document gives with a title.

    people: (name), each once. Pairs of capitalised words are cut down by a filter over the names before
    they are joined, and a name that very many documents have is joined as a hot key."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, p) for r, text in zip(pdf["rid"], pdf["text"], strict=True) for p in capital_pairs(text)]
            yield pd.DataFrame(rows, columns=["rid", "name"])

    met = numbered.select("rid", "text").mapInPandas(pairs, "rid long, name string").where(prune_filter(people, "name"))
    met = materialise(spark, met, "name-pairs")
    counts = met.groupBy("name").agg(F.count("*").alias("n"))
    total = max(1, met.count())
    real = skew_join(met, materialise(spark, people.join(counts, "name"), "names"), "name", "n", "rid", total).where("n is not null")
    return materialise(spark, real.groupBy("rid").agg(F.array_sort(F.collect_set("name")).alias("known")), "known-names")


def replace_entities(spark: SparkSession, docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities, the number of each kind, and spans (kind:start:end in
    code points of the text before, comma-joined) for each row of docs (doc_id, text).

    Emails, cards, phones, IP addresses, national numbers (ddd-dd-dddd), IBANs and names are found. A name
    is what follows a title, its further mentions in the document (whole, or one of its words), and in any
    other document the whole name and from then on its words. Names that no document gives with a title
    are not found. Null text counts as empty; repeated rows are treated alike; a document without entities
    keeps its text as it is; other columns are ignored; an empty table gives an empty result.
    """
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "text")
    entities = rows.select("text").mapInPandas(distinct_entities, ENTITY + ", gender string")
    # A gender that only some titles tell holds for all mentions; one that they contradict for none.
    told = F.array_remove(F.collect_set("gender"), "")
    entities = materialise(spark, entities.groupBy("kind", "entity").agg(F.when(F.size(told) == 1, told[0]).otherwise("").alias("gender")), "entities")
    again = collisions(spark, entities.where("kind = 'name'"), key)
    people = entities.where("kind = 'name' and entity like 'first:%'").select(F.substring("entity", 7, 1 << 20).alias("name"))
    some_names, some_again = people.limit(1).count(), again.limit(1).count()
    none = rows.withColumns({"others": F.lit(None).cast(OTHERS), "known": F.lit(None).cast("array<string>")})
    if not some_names and not some_again:
        return none.mapInPandas(lambda it: replace_batches(it, key), REPLACED)

    numbered = materialise(spark, rows.withColumn("rid", F.monotonically_increasing_id()), "numbered") if some_names else rows.withColumn("rid", F.monotonically_increasing_id())
    known = names_elsewhere(spark, numbered, people) if some_names else None
    asked = numbered.join(known, "rid", "left") if some_names else numbered.withColumn("known", F.lit(None).cast("array<string>"))

    def occurrences(batches):
        for pdf in batches:
            out = [(r, k, e) for r, text, names in zip(pdf["rid"], pdf["text"], pdf["known"], strict=True) for k, e in {(k, e) for _, _, k, c, _ in find_entities(text, frozenset(() if names is None else names)) for e in parts_of(k, c)}]
            yield pd.DataFrame(out, columns=["rid", "kind", "entity"])

    where = asked.select("rid", "text", "known").mapInPandas(occurrences, "rid long, " + ENTITY).withColumn("which", F.concat_ws(" ", "kind", "entity"))
    where = materialise(spark, where, "occurrences")
    counts = where.groupBy("which").agg(F.count("*").alias("n"))
    tried = materialise(spark, again.withColumn("which", F.concat_ws(" ", "kind", "entity")).select("which", "attempt", "gender").join(counts, "which"), "tried")
    met = skew_join(where, tried, "which", "n", "rid", max(1, where.count())).where("n is not null")
    others = materialise(spark, met.groupBy("rid").agg(F.collect_list(F.struct("kind", "entity", "attempt", "gender")).alias("others")), "others")
    return asked.join(others, "rid", "left").select("doc_id", "text", "others", "known").mapInPandas(lambda it: replace_batches(it, key), REPLACED)
