"""Sections of notes and their leading fields as expressions, and forgetting sections of notes as tables.

A note stays in its row: its lines are an array, headings are places in it, and the zone of fields at a
section's head is what comes before the first line that is no field, or repeats one that may stand once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashtags, trim, wikilinks
from ..operators.running import running_sum

# The formats of headings and fields.
HEADING = r"(?U)^##\s+([0-9]{1,2}:[0-9]{2})\s*$"
MOOD = r"(?U)^([\w-]+?)(?:/([0-9]+))?\s*$"
SUPERSEDED = r"(?U)^superseded::\s*([0-9]{4}-[0-9]{2}-[0-9]{2}#[0-9]+)\s*$"
VERB = r"(?U)^([\w-]+)::\s*(.*)$"
LINK = r"\[\[([^\[\]]+?)\]\]"
RESERVED = ["mood", "tags"]
#: What is in a line that trim leaves something of; it is found at once, where trim goes through the whole line.
SOME = r"(?U)[^\s\x{FEFF}]"
SECTION = "note, ordinal, time, at, end, mood, intensity, superseded, tags, relations, links, text"


def _upto(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _places(lines: str, test) -> Column:
    """The places of lines that pass."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def _blank(line: Column) -> Column:
    return ~line.rlike(SOME)


def _field(line: Column) -> Column:
    """What a trimmed line is as a field: kind (mood, once, relation, late or tags; null if none), word, number, values.
    once is a superseded line; late a relation of that verb, which only counts behind one."""
    value = trim(F.substring(line, 7, 1 << 20))
    word, number = F.regexp_extract(value, MOOD, 1), F.regexp_extract(value, MOOD, 2)
    level = F.expr("cast(null as int)") if number is None else number.try_cast("int")
    is_mood = line.startswith("mood::") & value.rlike(MOOD) & ((number == "") | F.coalesce(level.between(1, 5), F.lit(False)))
    tags = F.filter(F.transform(F.split(F.substring(line, 7, 1 << 20), ","), trim), lambda t: t != "")
    is_tags = line.startswith("tags::") & ~line.contains("[[") & (F.size(tags) > 0)
    verb, told = F.lower(F.regexp_extract(line, VERB, 1)), F.regexp_extract(line, VERB, 2)
    targets = wikilinks(told)
    bare = F.regexp_replace(F.regexp_replace(told, LINK, ""), r"(?U)[,\s]+", "") == ""
    is_relation = line.rlike(VERB) & ~verb.isin(RESERVED) & (F.size(targets) > 0) & bare
    late = line.startswith("superseded::")
    kind = F.when(is_mood, "mood").when(line.rlike(SUPERSEDED), "once").when(is_tags, "tags").when(is_relation, F.when(late, "late").otherwise("relation"))
    found = F.when(is_mood, word).when(line.rlike(SUPERSEDED), F.regexp_extract(line, SUPERSEDED, 1)).when(is_relation, verb)
    return F.struct(kind.alias("kind"), found.alias("word"), F.when(is_mood, level).alias("number"), F.when(is_tags, tags).when(is_relation, targets).alias("values"))


def _with_zone(df: DataFrame, repeated: bool) -> DataFrame:
    """Adds _first (the first line of own that isn't blank) and _zone (the fields ahead of its text)."""
    df = df.withColumn("_first", F.coalesce(F.get(_places("own", lambda x, i: ~_blank(x)), F.lit(0)), F.size("own")))
    # A field has two colons: no other line is trimmed or held against the patterns, and what is, is trimmed once.
    head = F.slice("own", F.col("_first") + 1, F.greatest(F.size("own") - F.col("_first"), F.lit(0)))
    df = df.withColumn("_head", F.transform(head, lambda x: F.when(x.contains("::"), trim(x))))
    df = df.withColumn("_fields", F.transform("_head", lambda x: F.when(x.isNotNull(), _field(x)))).withColumn("_kinds", F.transform("_fields", lambda f: F.coalesce(f["kind"], F.lit(""))))

    def ends(kind: Column, i: Column) -> Column:
        if repeated:
            return kind == ""
        again = kind.isin("mood", "once") & (F.array_position("_kinds", kind) - 1 < i)
        early = (kind == "late") & ~F.array_position("_kinds", "once").between(1, i)
        return (kind == "") | again | early

    stop = F.coalesce(F.get(_places("_kinds", ends), F.lit(0)), F.size("_kinds"))
    return df.withColumn("_stop", stop).withColumn("_zone", F.slice("_fields", F.lit(1), F.col("_stop"))).drop("_head", "_fields", "_kinds")


def _cut(df: DataFrame, body: Column) -> DataFrame:
    """Adds _lines and _heads, the places of headings that count: at the start or after a blank line."""
    df = df.withColumn("_lines", F.split(body, "\n", -1))
    return df.withColumn("_heads", _places("_lines", lambda x, i: x.startswith("##") & F.regexp_replace(x, "\r+$", "").rlike(HEADING) & ((i == 0) | _blank(F.get("_lines", i - 1)))))


def _sections(cut: DataFrame, *keep: str) -> DataFrame:
    """A row for each section: ordinal, at and end (its lines), head and own (its lines but the heading)."""
    end = lambda k: F.coalesce(F.get("_heads", k + 1), F.size("_lines"))
    made = F.transform("_heads", lambda at, k: F.struct(k.alias("ordinal"), at.alias("at"), end(k).alias("end"), F.get("_lines", at).alias("head"), F.slice("_lines", at + 2, end(k) - at - 1).alias("own")))
    return cut.select(*keep, F.inline(made))


def sections(notes: DataFrame) -> DataFrame:
    """The sections of notes (note, body without frontmatter): a row of SECTION for each, in the JVM.

    A heading counts at the note's start or after a blank line. The fields at a section's head give mood (with
    intensity), superseded, tags and relations; hashtags of the text are tags as well. The text is as written,
    without outer blank lines. A null body has no sections, nor has one without headings.
    """
    rows = _sections(_cut(notes, F.regexp_replace("body", "\r\n", "\n")), "note")
    rows = _with_zone(rows, repeated=False)
    kept = _places("own", lambda x, i: (i >= F.col("_first") + F.col("_stop")) & ~_blank(x))
    rows = rows.withColumn("_kept", kept)
    first, last = F.get("_kept", F.lit(0)), F.try_element_at("_kept", F.lit(-1))
    rows = rows.withColumn("text", F.coalesce(F.array_join(F.slice("own", first + 1, last - first + 1), "\n"), F.lit("")))
    of = lambda *kinds: F.filter("_zone", lambda f: f["kind"].isin(*kinds))
    mood, old = F.get(of("mood"), F.lit(0)), F.get(of("once"), F.lit(0))
    rows = rows.withColumn("_rel", of("relation", "late")).withColumn("_verbs", F.array_distinct(F.transform("_rel", lambda f: f["word"])))
    values = lambda v: F.array_distinct(F.flatten(F.transform(F.filter("_rel", lambda f: f["word"] == v), lambda f: f["values"])))
    return rows.select(
        "note", "ordinal", F.regexp_extract("head", HEADING, 1).alias("time"), "at", "end", mood["word"].alias("mood"), mood["number"].alias("intensity"), old["word"].alias("superseded"),
        F.array_distinct(F.concat(F.flatten(F.transform(of("tags"), lambda f: f["values"])), hashtags(F.col("text")))).alias("tags"),
        F.map_from_arrays("_verbs", F.transform("_verbs", values)).alias("relations"), wikilinks(F.col("text")).alias("links"), "text",
    )


def forget_in_notes(notes: DataFrame, doomed: DataFrame, redact: bool = False) -> DataFrame:
    """notes (note, body) without the sections of doomed (note, ordinal), byte for byte the rest. With redact a line
    with the note's name stands in place of a section's text; its heading, fields and last blank lines stay.

    Only notes with doomed sections are in the result. Ordinals that a note doesn't have change nothing.
    """
    gone = doomed.groupBy("note").agg(F.collect_set(F.col("ordinal").cast("int")).alias("_gone"))
    cut = _cut(notes.select("note", "body").join(gone, "note"), F.col("body"))
    rows = _sections(cut, "note", "_gone").withColumn("_goes", F.array_contains("_gone", F.col("ordinal")))
    if redact:
        rows = _with_zone(rows, repeated=True)
        body = F.col("_first") + F.when(F.col("_first") < F.size("own"), F.col("_stop")).otherwise(0)
        last = F.coalesce(F.try_element_at(_places("own", lambda x, i: ~_blank(x)), F.lit(-1)) + 1, F.lit(0))
        rest = F.greatest(last, body)
        kept = F.concat(F.array("head"), F.slice("own", F.lit(1), body), F.array(F.concat(F.lit("[redacted "), "note", F.lit("]"))), F.slice("own", rest + 1, F.size("own") - rest))
    else:
        kept = F.array().cast("array<string>")
    lines = F.when(F.col("_goes"), kept).otherwise(F.concat(F.array("head"), F.col("own")))
    after = rows.groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", lines.alias("l")))), lambda s: s["l"]).alias("_after"))
    before = cut.select("note", F.slice("_lines", F.lit(1), F.coalesce(F.get("_heads", F.lit(0)), F.size("_lines"))).alias("_before"))
    none = F.array().cast("array<string>")
    return before.join(after, "note", "left").select("note", F.array_join(F.concat("_before", F.coalesce(F.flatten("_after"), none)), "\n").alias("body"))


def forget_rows(rows: DataFrame, doomed: DataFrame, reference: str | None = None) -> DataFrame:
    """Sections as a table (note, ordinal, others) without those of doomed (note, ordinal): later ones of their
    note move up. reference names a column of the ordinal of another section of the note: it follows that
    section, and is null where it is gone or was never there.

    The sections of a note are counted by a distributed running sum, so one note may have very many. Each
    (note, ordinal) is there once; notes and ordinals are not null.
    """
    marks = doomed.select("note", "ordinal").distinct().withColumn("_gone", F.lit(1))
    asked = rows.join(marks, ["note", "ordinal"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))
    moved = running_sum(asked, ["note"], ["ordinal"], "_gone", "_before").withColumn("_now", (F.col("ordinal") - F.col("_before")).cast(rows.schema["ordinal"].dataType))
    left = moved.where("_gone = 0")
    if reference:
        names = left.select("note", F.col("ordinal").alias(reference), F.col("_now").alias("_to"))
        left = left.join(names, ["note", reference], "left").drop(reference).withColumnRenamed("_to", reference)
    return left.drop("ordinal", "_gone", "_before").withColumnRenamed("_now", "ordinal").select(*rows.columns)
