"""Deterministic analytics over the derived tables: digest, statistics, lint, insights, suggestions.

Every finding carries its evidence. Where evidence has no bound it is rows of its own (pair_evidence,
spike_evidence); nested evidence holds the first few. Each function is a DataFrame plan; orders are total.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_gap, in_range, middle
from ..functions.similarity import jaro_winkler_udf, name_words, numbered_near_udf
from ..functions.text import first_line, fold, round_up, snippet, trim
from ..sources.storage import materialise
from .search import with_mentions
from .tables import Diary

FLAT = 0.25
STREAK_DAYS, PAIR_MIN, SPIKE_MIN, SPIKE_FACTOR, SILENCE_MENTIONS, SILENCE_DAYS, SILENCE_EVIDENCE = 4, 4, 4, 3, 3, 60, 3
MISSING_LIMIT, TOP_RELATIONS, TAG_LIMIT, TAG_EXAMPLES = 50, 5, 30, 3
BRIDGE_MIN, BRIDGE_LIMIT, BRIDGE_EVIDENCE = 3, 10, 5
#: Entry ids that a finding nests; all of them are rows of the evidence functions.
INSIGHT_EVIDENCE = 100
SUPERSEDE_DAYS, SUPERSEDE_LIMIT, ALIAS_LEAST, ALIAS_CONTAINED = 7, 10, 0.85, 0.9
#: Names that differ in their number only are counted by classes from so many on. A choice of plan: the count is the same.
ALIAS_CROWD = 50
# Types of which one is current at a time, and verbs whose targets are people.
CURRENT_TYPES = ["employer", "workplace", "job", "company"]
PERSON_VERBS = ["with", "joy", "trigger", "eases"]


def _half(c: Column) -> Column:
    return round_up(c, 1)


def trend(first: Column, second: Column) -> Column:
    return F.when(first.isNull() | second.isNull(), "insufficient_data").when(F.abs(second - first) < FLAT, "flat").when(second > first, "rising").otherwise("falling")


def mood_distribution(entries: DataFrame, start=None, end=None) -> DataFrame:
    return entries.where(in_range(F.col("date"), start, end) & F.col("mood").isNotNull()).groupBy("mood").agg(F.count("*").alias("n"))


def mood_stats(entries: DataFrame, start: str, end: str) -> DataFrame:
    """One row: entries with a mood, average intensity (one decimal), and the trend from the first to the second half."""
    mid = middle(start, end)
    rows = entries.where(in_range(F.col("date"), start, end) & F.col("mood").isNotNull())
    early = F.avg(F.when(F.col("date") < mid, F.col("intensity")))
    late = F.avg(F.when(F.col("date") >= mid, F.col("intensity")))
    return rows.agg(F.count("*").alias("n"), _half(F.avg("intensity")).alias("avg_intensity"), trend(early, late).alias("trend"))


def health_stats(daily_meta: DataFrame, start: str, end: str) -> DataFrame:
    mid = middle(start, end)
    rows = daily_meta.where(in_range(F.col("date"), start, end))
    early = F.avg(F.when(F.col("date") < mid, F.col("mood_score")))
    late = F.avg(F.when(F.col("date") >= mid, F.col("mood_score")))
    return rows.agg(_half(F.avg("sleep_hours")).alias("avg_sleep"), F.count_if(trim(F.col("exercise")) != "").alias("exercise_days"), trend(early, late).alias("mood_score_trend"))


def checkin_days(daily_meta: DataFrame, start=None, end=None) -> DataFrame:
    some = F.coalesce(F.col("sleep_hours").cast("string"), F.col("exercise"), F.col("mood_score").cast("string")).isNotNull()
    return daily_meta.where(in_range(F.col("date"), start, end) & some).agg(F.count("*").alias("days_logged"), _half(F.avg("sleep_hours")).alias("avg_sleep"))


def with_dated_links(diary: Diary, *columns: str) -> Diary:
    """The diary with its links (these columns of them, or all) written once, each with its entry's date and ordinal, and
    placed, null where there is no such entry: what reads dated links doesn't join them with entries again."""
    if "placed" in diary.links.columns:
        return diary
    when = diary.entries.select(F.col("id").alias("entry_id"), "date", "ordinal", F.lit(True).alias("placed"))
    rows = diary.links.select(*(columns or ["*"])).join(when, "entry_id", "left")
    return replace(diary, links=materialise(rows.sparkSession, rows, "links"))


def links_in_range(diary: Diary, start=None, end=None) -> DataFrame:
    if "placed" in diary.links.columns:
        return diary.links.where(F.col("placed") & in_range(F.col("date"), start, end)).drop("placed")
    return diary.links.join(diary.entries.where(in_range(F.col("date"), start, end)).select(F.col("id").alias("entry_id"), "date", "ordinal"), "entry_id")


def active_entities(diary: Diary, start=None, end=None, limit: int = 5) -> DataFrame:
    return links_in_range(diary, start, end).groupBy(F.col("target").alias("name")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(limit)


def recent_entries(entries: DataFrame, start=None, end=None, limit: int = 5) -> DataFrame:
    best = entries.where(in_range(F.col("date"), start, end)).orderBy(F.desc("date"), F.desc("ordinal"), "id").limit(limit)
    return best.select("id", "date", "time", "mood", first_line(F.col("body"), 100).alias("first_line"), snippet(F.col("body")).alias("snippet"))


def digest(diary: Diary, start: str, end: str) -> DataFrame:
    """One row that nests the period's mood summary, check-ins, active entities and newest entries."""
    moods = mood_distribution(diary.entries, start, end).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mood", "n")))).alias("distribution"))
    mood = mood_stats(diary.entries, start, end).select("avg_intensity")
    named = active_entities(diary, start, end).agg(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("k"), "name", "mentions"))).alias("x")).select(F.transform("x", lambda s: F.struct(s["name"].alias("name"), s["mentions"].alias("mentions"))).alias("active_entities"))
    recent = recent_entries(diary.entries, start, end).agg(F.reverse(F.array_sort(F.collect_list(F.struct("date", "id", "time", "mood", "first_line", "snippet")))).alias("recent_entries"))
    period = F.struct(F.lit(start).alias("from"), F.lit(end).alias("to")).alias("period")
    return reduce(lambda a, b: a.join(F.broadcast(b)), [moods, mood, checkin_days(diary.daily_meta, start, end), named, recent]).select(period, "*")


def entity_list(diary: Diary, kind: str | None = None) -> DataFrame:
    rows = diary.entities if kind is None else diary.entities.where(F.lower("type") == kind.lower())
    return with_mentions(rows, diary.links).select("name", "type", "aliases", "mentions").orderBy(F.desc("mentions"), F.collate(F.col("name"), "UNICODE"), "name")


# Lint


def unknown_types(diary: Diary) -> DataFrame:
    return with_mentions(diary.entities.where(F.col("type") == "unknown"), diary.links).select("name", "file", "mentions")


def orphans(diary: Diary) -> DataFrame:
    keys = diary.links.select(F.col("target_key").alias("name_key")).distinct()
    return diary.entities.join(keys, "name_key", "left_anti").select("name", "file")


def broken_links(diary: Diary) -> DataFrame:
    """Link targets that are no entity, with the first entry of each spelling."""
    known = diary.entities.select(F.col("name_key").alias("target_key")).distinct()
    spelled = diary.links.groupBy("target", "target_key").agg(F.min("entry_id").alias("entry_id"))  # names are joined, not links
    return spelled.join(known, "target_key", "left_anti").groupBy("target").agg(F.min("entry_id").alias("entry_id"))


def entries_without_links(diary: Diary) -> DataFrame:
    return diary.entries.join(diary.links.select(F.col("entry_id").alias("id")), "id", "left_anti").select("id", "file", first_line(F.col("body"), 80).alias("first_line"))


def moods_without_intensity(diary: Diary) -> DataFrame:
    return diary.entries.where("mood is not null and intensity is null").select("id", "date", "mood")


def days_without_checkin(diary: Diary) -> DataFrame:
    some = "sleep_hours is not null or exercise is not null or mood_score is not null"
    return diary.entries.join(diary.daily_meta.where(some).select("date"), "date", "left_anti").select("date").distinct()


# Insights: (kind, detail, evidence)


def mood_streak(diary: Diary, start: str, end: str) -> DataFrame:
    """The longest run of days in a row with falling average intensity; the earliest of equal length."""
    days = diary.entries.where(in_range(F.col("date"), start, end) & F.col("intensity").isNotNull()).groupBy("date").agg(F.avg("intensity").alias("avg"))
    order = Window.orderBy("date")  # a row a day
    falls = (F.col("avg") < F.lag("avg").over(order)) & (day_gap(F.col("date"), F.lag("date").over(order)) == 1)
    marked = days.withColumn("start", (~F.coalesce(falls, F.lit(False))).cast("int"))
    runs = marked.withColumn("run", F.sum("start").over(order)).groupBy("run").agg(F.array_sort(F.collect_list("date")).alias("evidence"))
    best = runs.where(F.size("evidence") >= STREAK_DAYS).orderBy(F.desc(F.size("evidence")), "run").limit(1)
    detail = F.format_string("Intensity declined %d days in a row (%s → %s).", F.size("evidence"), F.element_at("evidence", 1), F.element_at("evidence", -1))
    return best.select(F.lit("mood_streak").alias("kind"), detail.alias("detail"), "evidence")


def first_few(rows: DataFrame, keys: list[str], most: int, *order) -> DataFrame:
    """(keys, evidence): the first entry ids of each group, in order. Spark cuts groups down to so many rows
    before it shuffles them, so a hot group stays small."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "entry_id"))), lambda s: s["entry_id"]).alias("evidence"))


def _pairs(diary: Diary, start: str | None, end: str | None) -> DataFrame:
    """(a, b, entry_id), a before b: an entry's links are one row, and its pairs come from it without a join."""
    own = links_in_range(diary, start, end).groupBy("entry_id").agg(F.sort_array(F.collect_set("target")).alias("own"))
    each = own.select("entry_id", "own", F.posexplode("own").alias("i", "a"))
    return each.select("entry_id", "a", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("b")).select("a", "b", "entry_id")


def target_pairs(diary: Diary, start: str | None = None, end: str | None = None, least: int = PAIR_MIN) -> DataFrame:
    """(a, b, n): targets linked by the same entries in range, least of them or more; pairs grow with an entry's own links only."""
    return _pairs(diary, start, end).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pair_evidence(diary: Diary, start: str | None = None, end: str | None = None, least: int = PAIR_MIN) -> DataFrame:
    """(a, b, n, entry_id): every entry of every such pair. The pairs are written first, so where they are few they are
    sent to the entries and nothing of these is shuffled."""
    few = materialise(diary.links.sparkSession, target_pairs(diary, start, end, least), "pairs")
    return _pairs(diary, start, end).join(few, ["a", "b"]).select("a", "b", "n", "entry_id")


def co_occurrence(diary: Diary, start: str, end: str) -> DataFrame:
    few = first_few(pair_evidence(diary, start, end), ["a", "b", "n"], INSIGHT_EVIDENCE, "entry_id")
    detail = F.format_string("[[%s]] and [[%s]] appeared together %d times.", "a", "b", "n")
    return few.select(F.lit("co_occurrence").alias("kind"), detail.alias("detail"), "evidence")


def spikes(diary: Diary, start: str, end: str) -> DataFrame:
    """(target, period_n, base_n): targets mentioned at least three times as often in the period as in all the time outside it."""
    rows = links_in_range(diary).groupBy("target").agg(F.count_if(in_range(F.col("date"), start, end)).alias("period_n"), F.count("*").alias("total_n"))
    base = F.col("total_n") - F.col("period_n")
    return rows.where((F.col("period_n") >= SPIKE_MIN) & (base > 0) & (F.col("period_n") >= base * SPIKE_FACTOR)).select("target", "period_n", base.alias("base_n"))


def spike_evidence(diary: Diary, start: str, end: str) -> DataFrame:
    """(target, period_n, base_n, entry_id, date, ordinal): every mention in the period of every such target. The targets
    are written first, as pairs are."""
    few = materialise(diary.links.sparkSession, spikes(diary, start, end), "spikes")
    return links_in_range(diary, start, end).join(few, "target").select("target", "period_n", "base_n", "entry_id", "date", "ordinal")


def silences(diary: Diary, end: str) -> DataFrame:
    rows = links_in_range(diary)
    last = rows.groupBy("target").agg(F.max("date").alias("last_date"), F.count("*").alias("n"))
    quiet = last.withColumn("gap", day_gap(F.lit(end), F.col("last_date"))).where((F.col("n") >= SILENCE_MENTIONS) & (F.col("gap") >= SILENCE_DAYS))
    quiet = materialise(rows.sparkSession, quiet, "silences")
    newest = first_few(rows.join(quiet.select("target"), "target", "left_semi"), ["target"], SILENCE_EVIDENCE, F.desc("date"), F.desc("ordinal"), "entry_id")
    return quiet.join(newest, "target").select("target", "last_date", "n", "gap", "evidence")


def insights(diary: Diary, start: str, end: str) -> DataFrame:
    """Links with their entries' dates are written once, as six plans read them."""
    diary = with_dated_links(diary, "entry_id", "target")
    said = lambda df, kind, text, *cols: df.select(F.lit(kind).alias("kind"), F.format_string(text, *cols).alias("detail"), "evidence")
    parts = [
        mood_streak(diary, start, end),
        co_occurrence(diary, start, end),
        said(first_few(spike_evidence(diary, start, end), ["target", "period_n", "base_n"], INSIGHT_EVIDENCE, F.desc("date"), F.desc("ordinal"), "entry_id"), "entity_spike", "[[%s]] mentioned %d× this period vs %d× before (spike).", "target", "period_n", "base_n"),
        said(silences(diary, end), "silence", "[[%s]] (frequent before) not mentioned for %d days; last on %s.", "target", "gap", "last_date"),
    ]
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


# Relations, tags, bridges


def missing_relations(diary: Diary, limit: int = MISSING_LIMIT) -> DataFrame:
    strong = diary.entries.where("intensity >= 4 or intensity <= 2")
    rows = strong.join(diary.relations.select(F.col("entry_id").alias("id")), "id", "left_anti")
    return rows.orderBy(F.desc("date"), F.desc("ordinal"), "id").limit(limit).select("id", "date", "mood", "intensity", first_line(F.col("body"), 80).alias("first_line"))


def relation_summary(diary: Diary, start: str, end: str, limit: int = TOP_RELATIONS) -> DataFrame:
    """The top targets of joy and trigger; spellings that fold alike count together, shown as most often written."""
    inside = diary.entries.where(in_range(F.col("date"), start, end)).select(F.col("id").alias("entry_id"))
    rows = diary.relations.where(F.col("rel_type").isin("joy", "trigger")).join(inside, "entry_id")
    each = rows.groupBy("rel_type", "target_key", "target").agg(F.count("*").alias("n"))
    both = each.groupBy("rel_type", "target_key").agg(F.sum("n").alias("n"), F.min_by("target", F.struct(-F.col("n"), "target")).alias("target"))
    nth = F.row_number().over(Window.partitionBy("rel_type").orderBy(F.desc("n"), "target"))
    return both.withColumn("nth", nth).where(F.col("nth") <= limit).select("rel_type", "nth", "target", "n")


def _loose_tags(diary: Diary, limit: int) -> DataFrame:
    """(tag, n): the most used tags that are no entity; spellings are joined with entities, not each use of them."""
    known = diary.entities.select(F.col("name_key").alias("tag_key")).distinct()
    each = diary.tags.groupBy("tag", "tag_key").agg(F.count("*").alias("n")).join(known, "tag_key", "left_anti")
    return each.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def unconverted_tags(diary: Diary, limit: int = TAG_LIMIT) -> DataFrame:
    """(tag, n, examples): tags that are no entity, the most used first, each with its least entry ids."""
    known = diary.entities.select(F.col("name_key").alias("tag_key")).distinct()
    loose, top = diary.tags.join(known, "tag_key", "left_anti"), _loose_tags(diary, limit)
    few = first_few(loose.join(top.select("tag"), "tag", "left_semi").select("tag", "entry_id").distinct(), ["tag"], TAG_EXAMPLES, "entry_id")
    return top.join(few, "tag").select("tag", "n", F.col("evidence").alias("examples")).orderBy(F.desc("n"), "tag")


def concept_bridges(diary: Diary, start: str, end: str) -> DataFrame:
    """Tags of three entries or more that are no entity and that most of these entries don't link yet."""
    inside = diary.entries.where(in_range(F.col("date"), start, end)).select(F.col("id").alias("entry_id"))
    known = diary.entities.select(F.col("name_key").alias("tag_key")).distinct()
    # The entries in range come down to what tags and links are made of; the tags that are left are written, as all below reads them.
    rows = diary.tags.join(inside, "entry_id", "left_semi").join(known, "tag_key", "left_anti").join(inside, "entry_id")
    rows = materialise(rows.sparkSession, rows.select("tag_key", "tag", "entry_id"), "bridges")
    spelled = rows.groupBy("tag_key", "tag").agg(F.count("*").alias("n")).groupBy("tag_key").agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("concept"))
    own = links_in_range(diary, start, end) if "placed" in diary.links.columns else diary.links.join(inside, "entry_id", "left_semi")
    have = own.select("entry_id", F.col("target_key").alias("tag_key"), F.lit(1).alias("linked")).distinct()
    each = rows.select("tag_key", "entry_id").distinct()
    groups = each.join(have, ["entry_id", "tag_key"], "left").groupBy("tag_key").agg(F.count("*").alias("entry_count"), F.count("linked").alias("linked"))
    open_ = groups.where((F.col("entry_count") >= BRIDGE_MIN) & (F.col("linked") * 2 <= F.col("entry_count"))).join(spelled, "tag_key")
    order = [F.desc("entry_count"), F.collate(F.col("concept"), "UNICODE"), F.col("concept")]
    top = open_.orderBy(*order).limit(BRIDGE_LIMIT)
    few = first_few(each.join(top.select("tag_key"), "tag_key", "left_semi"), ["tag_key"], BRIDGE_EVIDENCE, "entry_id")
    return top.join(few, "tag_key").select("concept", "entry_count", "evidence").orderBy(*order)


def moods_without_relation(diary: Diary) -> DataFrame:
    """Entries with a mood that have none of the emotional relations."""
    have = diary.relations.where(F.col("rel_type").isin(PERSON_VERBS)).select(F.col("entry_id").alias("id"))
    return diary.entries.where("mood is not null").join(have, "id", "left_anti").select("id", "date", "ordinal", "mood", "body")


def tagged_without_links(diary: Diary) -> DataFrame:
    """Entries that have a tag and link nothing."""
    tagged = diary.entries.join(diary.tags.select(F.col("entry_id").alias("id")), "id", "left_semi")
    return tagged.join(diary.links.select(F.col("entry_id").alias("id")), "id", "left_anti").select("id", "date", "body")


# Suggestions


def superseded_candidates(diary: Diary, start: str, end: str, types: list[str] | None = None, limit: int | None = SUPERSEDE_LIMIT) -> DataFrame:
    """Pairs of entries, the newer of which seems to replace a fact of the older.

    Both link an entity of one such type, different ones that neither mentions together, and share
    another link; they lie a week apart. For each pair the first typed pair by link order counts.

    Pairs come from the links that they share (an equi-join on the target), not from their type. Each side
    brings its entry's links along, so a pair is judged within its row, and only in the row of its first
    shared link, which is the context: no pair is shuffled. What both link is in what they share, so a typed
    pair is good exactly if neither of it is shared; an entry whose typed links are all the target itself is
    left out ahead of the join. Without a limit the pairs come in no order.
    """
    types = types or CURRENT_TYPES
    typed = diary.entities.where(F.lower("type").isin(types)).groupBy("name_key").agg(F.max_by(F.struct(F.lower("type").alias("type"), F.col("name").alias("shown")), "name").alias("e"))
    inside = diary.entries.where(in_range(F.col("date"), start, end)).select(F.col("id").alias("entry_id"), "date", "ordinal")
    links = links_in_range(diary, start, end).drop("date", "ordinal") if "placed" in diary.links.columns else diary.links
    each = links.where("target_key is not null").join(typed.select(F.col("name_key").alias("target_key"), "e"), "target_key", "left")
    own = each.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct("pos", "target", "target_key", "e"))).alias("own")).where(F.exists("own", lambda x: x["e"].isNotNull()))
    hits = F.transform(F.filter("own", lambda x: x["e"].isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), x["e"]["shown"].alias("shown"), x["e"]["type"].alias("type"), x["target_key"].alias("key")))
    notes = own.join(inside, "entry_id").select("entry_id", "date", "ordinal", day_gap(F.col("date"), F.lit("1970-01-01")).alias("day"), "own", F.transform("own", lambda x: x["target_key"]).alias("keys"), hits.alias("hits"))
    notes = notes.withColumn("typed", F.transform("hits", lambda h: h["key"]))
    has = ["entry_id", "date", "ordinal", "day", "keys", "hits", "typed"]
    other = F.exists("hits", lambda h: h["key"] != F.col("target_key"))
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in has]
    a = notes.join(diary.superseded.select("entry_id"), "entry_id", "left_anti").select(*side("a"), F.posexplode("own").alias("place", "x")).withColumns({"target_key": F.col("x.target_key"), "hits": F.col("a_hits")})
    a = a.where(other).select("target_key", F.col("x.target").alias("shared_context"), "place", *(f"a_{c}" for c in has))
    b = notes.select(*side("b"), "hits", F.explode(F.array_distinct("keys")).alias("target_key")).where(other).drop("hits")
    near = a.join(b, "target_key").where(F.col("b_day") - F.col("a_day") >= SUPERSEDE_DAYS)
    near = near.where((F.size(F.array_except("a_typed", "b_keys")) > 0) & (F.size(F.array_except("b_typed", "a_keys")) > 0) & ~F.arrays_overlap(F.slice("a_keys", F.lit(1), F.col("place")), F.col("b_keys")))
    loose = lambda hits, keys: F.filter(hits, lambda h: ~F.array_contains(keys, h["key"]))
    both = lambda x, y: F.struct(x["pos"].alias("a_pos"), x["shown"].alias("a_shown"), y["pos"].alias("b_pos"), y["shown"].alias("b_shown"), x["type"].alias("type"))
    met = F.flatten(F.transform(loose("a_hits", F.col("b_keys")), lambda x: F.transform(F.filter(loose("b_hits", F.col("a_keys")), lambda y: y["type"] == x["type"]), lambda y: both(x, y))))
    out = near.withColumn("f", F.array_min(met))
    out = out.where("f is not null") if len(set(types)) > 1 else out  # of one type, all that are left are good
    if limit is not None:
        out = out.orderBy(F.desc("a_date"), F.desc("a_ordinal"), "a_entry_id", F.desc("b_date"), F.desc("b_ordinal"), "b_entry_id").limit(limit)
    return out.select(F.col("a_entry_id").alias("older_id"), F.col("b_entry_id").alias("newer_id"), "f.type", F.col("f.a_shown").alias("old_entity"), F.col("f.b_shown").alias("new_entity"), "shared_context")


def _contained_pairs(names: DataFrame) -> DataFrame:
    """(a, b, contained) of names (name, words): the smaller name offers its rarest word, the larger all of its words."""
    spread = names.select("name", "words", F.explode("words").alias("w"))
    df = spread.groupBy("w").agg(F.count("*").alias("df"))
    rare = spread.join(df, "w").groupBy("name", "words").agg(F.min(F.struct("df", "w"))["w"].alias("w"))
    small, large = rare.toDF("s", "s_words", "w"), spread.toDF("l", "l_words", "w")
    within = small.join(large, "w").where((F.size("s_words") < F.size("l_words")) & (F.size(F.array_except("s_words", "l_words")) == 0))
    return within.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), F.lit(True).alias("contained")).distinct()


def alias_candidates(entities: DataFrame, least: float = ALIAS_LEAST) -> DataFrame:
    """Pairs of names that may be one entity: similar when folded, or one's words within the other's; the
    most similar first.

    Candidates come from keys, not from all pairs. A name whose words lie within another's shares its
    rarest word with it. Two names of a and b characters at a Jaro-Winkler similarity of s have in common
    at least c * a * b / (a + b) characters, c = 3 j - 1 with j = (s - 0.4) / 0.6 the least Jaro similarity.
    So they share one of each one's rarest characters, of as many as it may lack and one more. A character
    counts with its occurrence in the name (the second 'n').
    """
    names = entities.select("name").distinct().withColumn("key", fold(F.col("name"))).withColumn("words", name_words(F.col("key")))
    contained = _contained_pairs(names)
    # Similarity: the rarest characters of each name, as many as its partner may lack and one more.
    c = 3 * (least - 0.4) / 0.6 - 1
    chars = names.where("key <> ''").select("name", "key", F.length("key").alias("n"), F.posexplode(F.split("key", "")).alias("i", "ch")).where("ch <> ''")
    nth = F.size(F.split(F.substring("key", 1, F.col("i") + 1), F.concat(F.lit("\\Q"), "ch", F.lit("\\E")))) - 1
    occurring = chars.withColumn("sign", F.concat("ch", F.lit(" "), nth.cast("string"))).select("name", "key", "n", "sign")
    often = occurring.groupBy("sign").agg(F.count("*").alias("often"))
    ranked = occurring.join(often, "sign").groupBy("name", "key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sign"))).alias("signs"))
    # The shortest partner that can be so similar has m = its own length: m / a + 1 >= c.
    fewest = F.greatest(F.lit(1.0), F.ceil(F.col("n") * F.lit(c - 1) - F.lit(1e-9)))
    overlap = F.ceil(F.lit(c) * F.col("n") * fewest / (F.col("n") + fewest) - F.lit(1e-9))
    offer = ranked.select("name", "key", "n", F.explode(F.slice("signs", F.lit(1), (F.col("n") - F.greatest(overlap, F.lit(1.0)) + 1).cast("int"))).alias("s")).select("name", "key", "n", "s.sign")
    x, y = offer.toDF("a", "a_key", "la", "sign"), offer.toDF("b", "b_key", "lb", "sign")
    shorter, longer = F.least("la", "lb"), F.greatest("la", "lb")
    reach = 0.6 * (2 + shorter / longer) / 3 + 0.4  # the best similarity of two such lengths
    near = x.join(y, "sign").where((F.col("a") < F.col("b")) & (reach >= least)).select("a", "b").distinct()
    equal = names.where("key = ''").select("name")  # empty keys are equal
    empty = equal.toDF("a").join(equal.toDF("b"), F.col("a") < F.col("b")).select("a", "b")
    pairs = near.unionByName(empty).withColumn("near", F.lit(True)).join(contained, ["a", "b"], "full_outer")
    keyed = pairs.join(names.select(F.col("name").alias("a"), F.col("key").alias("a_key")), "a").join(names.select(F.col("name").alias("b"), F.col("key").alias("b_key")), "b")
    scored = keyed.select("a", "b", jaro_winkler_udf("a_key", "b_key").alias("sim"), F.coalesce("contained", F.lit(False)).alias("contained")).where(f"sim >= {least} or contained")
    similarity = F.when(F.col("contained"), F.greatest(F.lit(ALIAS_CONTAINED), round_up(F.col("sim"), 3))).otherwise(round_up(F.col("sim"), 3))
    hint = F.when(F.col("contained"), "One name contains the other (honorific/prefix?) — likely same entity.").otherwise("Possible same entity — review and `entity merge` if so.")
    return scored.select("a", "b", similarity.alias("similarity"), hint.alias("hint")).orderBy(F.desc("similarity"), "a", "b")


def alias_count(entities: DataFrame, least: float = ALIAS_LEAST, crowd: int = ALIAS_CROWD) -> DataFrame:
    """(n): how many pairs alias_candidates has, exactly; pairs of numbered names are counted, not listed.

    Where a crowd of names differ in the number at their end only ("Supplier 17"), their pairs are as many as they are. Names fall
    into classes by what stands before the number (the stem), the number's length and, for one stem, its first digits and which
    digits follow. Two classes whose pairs all are similar, or none, count by their sizes; of the others the names are compared.
    Names that share their first q characters match there place by place, so with k more matches of which all are out of order
    the similarity is at least that of q + k matches, k / 2 of them swaps, which does not fall in k for q (1/a + 1/b) >= 1/2.
    """
    spark = entities.sparkSession
    names = entities.where("name is not null").select("name").distinct().withColumn("key", fold(F.col("name")))
    names = names.withColumn("stem", F.regexp_replace("key", r"[0-9]+\z", "")).withColumn("digits", F.expr("substring(key, length(stem) + 1)")).withColumn("d", F.length("digits"))
    crowds = names.where("d > 0").groupBy("stem").agg(F.count("*").alias("crowd"), F.max("d").alias("longest")).where(F.col("crowd") >= crowd)
    names = materialise(spark, names.join(crowds.select("stem", "longest", F.lit(True).alias("in_crowd")), "stem", "left").withColumn("numbered", F.col("in_crowd").isNotNull() & (F.col("d") > 0)).drop("in_crowd"), "names")
    numbered, plain = names.where("numbered"), names.where("not numbered")
    total = lambda df, n: df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"))
    near = lambda a, b: jaro_winkler_udf(F.when(F.col("a") < F.col("b"), a).otherwise(b), F.when(F.col("a") < F.col("b"), b).otherwise(a)) >= least
    side = lambda df, s, *cols: df.select(F.col("name").alias(s), F.col("key").alias(f"{s}_key"), *cols)
    parts = [total(alias_candidates(plain, least), F.lit(1))]

    # Numbered names that are in another's words, or have its words among theirs, and are not similar.
    within = _contained_pairs(names.withColumn("words", name_words(F.col("key"))))
    within = within.join(side(names, "a", F.col("numbered").alias("a_numbered")), "a").join(side(names, "b", F.col("numbered").alias("b_numbered")), "b").where("a_numbered or b_numbered")
    parts.append(total(within.where(~near(F.col("a_key"), F.col("b_key"))), F.lit(1)))

    # A class of one stem with those of others, and with each plain name.
    kinds = numbered.groupBy("stem", "d").agg(F.count("*").alias("n")).withColumn("numbered", F.lit(True))
    single = plain.groupBy(F.col("key").alias("stem")).agg(F.count("*").alias("n")).select("stem", F.lit(0).alias("d"), "n", F.lit(False).alias("numbered"))
    x, y = (df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for df, s in ((kinds, "x"), (kinds.unionByName(single), "y")))
    met = F.broadcast(x).join(y, ~F.col("y_numbered") | (F.col("x_stem") < F.col("y_stem")))
    met = materialise(spark, met.withColumn("near", numbered_near_udf(least)("x_stem", "x_d", "y_stem", "y_d")).where("near <> 0"), "kinds")
    parts.append(total(met.where("near = 1"), F.col("x_n") * F.col("y_n")))
    named = side(names, "b", F.col("numbered").alias("y_numbered"), F.when(F.col("numbered"), F.col("stem")).otherwise(F.col("key")).alias("y_stem"), F.when(F.col("numbered"), F.col("d")).otherwise(0).alias("y_d"))
    open_ = met.where("near = -1").join(side(numbered, "a", F.col("stem").alias("x_stem"), F.col("d").alias("x_d")), ["x_stem", "x_d"]).join(named, ["y_numbered", "y_stem", "y_d"])
    parts.append(total(open_.where(near(F.col("a_key"), F.col("b_key"))), F.lit(1)))

    # Names of one stem: from so many equal first digits on all are similar; with fewer (same) it depends on what follows.
    c = 3 * (least - 0.4) / 0.6 - 1
    size = F.length("stem")
    enough = F.greatest(F.lit(0), F.least(F.col("longest"), F.greatest(F.lit(4), F.ceil(F.lit(max(c, 0.5) / 2) * (size + F.col("longest")) + F.lit(1e-6))).cast("int") - size))
    heads = numbered.withColumn("enough", enough)
    alike = heads.where("d >= enough").groupBy("stem", F.expr("substring(digits, 1, enough)").alias("head")).agg(F.count("*").alias("n"))
    parts.append(total(alike, F.col("n") * (F.col("n") - 1) / 2))
    cut = heads.where("enough > 0").withColumn("same", F.explode(F.sequence(F.lit(0), F.least("enough", F.col("d") + 1) - 1)))
    tail = F.expr("substring(digits, same + 1)")
    has = sum((F.when(F.contains(tail, F.lit(str(i))), 1 << i).otherwise(0) for i in range(10)), F.lit(0))
    cut = cut.select("name", "key", "stem", "same", F.expr("substring(digits, 1, same)").alias("head"), F.expr("substring(digits, same + 1, 1)").alias("next"), "d", has.alias("has"))
    groups = materialise(spark, cut.groupBy("stem", "same", "head", "next", "d", "has").agg(F.count("*").alias("n")), "heads")
    parts.append(total(groups.where("next = ''"), F.col("n") * (F.col("n") - 1) / 2))
    own = ["stem", "same", "head"]
    x, y = (groups.select(*own, *(F.col(c).alias(f"{s}_{c}") for c in ("next", "d", "has", "n"))) for s in "xy")
    y = y.withColumn("x_next", F.explode(F.filter(F.array(*map(F.lit, ["", *"0123456789"])), lambda c: c < F.col("y_next"))))  # a crowd's classes meet in several tasks
    a, b, q = F.length("stem") + F.col("x_d"), F.length("stem") + F.col("y_d"), F.length("stem") + F.col("same")
    reach = F.greatest(F.lit(0), F.floor(F.greatest(a, b) / 2) - 1)
    shared = F.bit_count(F.col("x_has").bitwiseAND(F.col("y_has")))
    similar = lambda m, unlike: F.when(m > 0, (m / a + m / b + (m - unlike / 2) / m) / 3).otherwise(F.lit(0.0))
    boosted = lambda j: j + F.least(F.lit(4), q) * F.lit(0.1) * (1 - j)
    k = F.when(F.greatest(a, b) - 1 - q <= reach, shared).otherwise(0)
    sure = (q * (1 / a + 1 / b) >= 0.5) & (boosted(similar(q + k, k)) >= least + 1e-9)
    never = boosted(similar(q + F.when(shared == 0, 0).otherwise(F.least(a, b) - q), F.lit(0))) < least - 1e-9
    met = x.join(y, [*own, "x_next"]).withColumn("near", F.when(sure, 1).when(never, 0).otherwise(-1)).where("near <> 0")
    parts.append(total(met.where("near = 1"), F.col("x_n") * F.col("y_n")))
    each = lambda s, o: cut.select(*own, F.col("next").alias(f"{o}_next"), F.col("d").alias(f"{o}_d"), F.col("has").alias(f"{o}_has"), F.col("name").alias(s), F.col("key").alias(f"{s}_key"))
    open_ = met.where("near = -1").select(*own, *(f"{o}_{c}" for o in "xy" for c in ("next", "d", "has"))).join(each("a", "x"), [*own, "x_next", "x_d", "x_has"]).join(each("b", "y"), [*own, "y_next", "y_d", "y_has"])
    parts.append(total(open_.where(near(F.col("a_key"), F.col("b_key"))), F.lit(1)))
    return reduce(DataFrame.unionAll, parts).agg(F.sum("n").alias("n"))


def type_suggestions(diary: Diary) -> DataFrame:
    """Entities of unknown type that are the target of a relation as only people are, with all verbs they
    are the target of (verbs) and the first of the telling ones (in the reason)."""
    each = diary.relations.select(F.col("target_key").alias("name_key"), F.lower("rel_type").alias("verb"))
    telling = F.when(F.col("verb").isin(PERSON_VERBS), F.col("verb"))
    verbs = each.groupBy("name_key").agg(F.array_sort(F.collect_set("verb")).alias("verbs"), F.min(telling).alias("verb")).where("verb is not null")
    reason = F.format_string('Target of a "%s::" emotional relation → likely a person.', "verb")
    return diary.entities.where(F.col("type") == "unknown").join(verbs, "name_key").select("name", "file", "verbs", F.lit("person").alias("suggested"), reason.alias("reason"))


def suggested_actions(diary: Diary, start: str, end: str) -> DataFrame:
    """(priority, action): one line for each kind of finding that is there, in a fixed order.

    Entities, tags, relations and links with their dates are written once, as all kinds read them; of few entities Spark
    then knows that they are few, and sends them to the links. What is only counted is not looked up in full.
    """
    spark = diary.entries.sparkSession
    diary = with_dated_links(replace(diary, **{t: materialise(spark, getattr(diary, t), t) for t in ("entities", "tags", "relations")}))

    def told(priority: int, n: DataFrame, text: str) -> DataFrame:
        return n.where("n > 0").select(F.lit(priority).alias("priority"), F.format_string(text, "n").alias("action"))

    def counted(priority: int, df: DataFrame, text: str) -> DataFrame:
        return told(priority, df.agg(F.count("*").alias("n")), text)

    def each(priority: int, df: DataFrame, text: str, *cols) -> DataFrame:
        return df.select(F.lit(priority).alias("priority"), F.format_string(text, *cols).alias("action"))

    parts = [
        counted(1, diary.entities.where(F.col("type") == "unknown"), "classify %d unknown-type entities"),
        told(2, alias_count(diary.entities), "review %d possible alias pairs"),
        counted(3, broken_links(diary), "fix %d broken wikilinks"),
        counted(4, entries_without_links(diary), "backfill links on %d entries"),
        counted(5, missing_relations(diary), "backfill emotional relation on %d strong-mood entries"),
        counted(6, _loose_tags(diary, TAG_LIMIT).where("tag is not null"), "convert %d tags to wikilinks/relations"),
        each(7, concept_bridges(diary, start, end), "add [[%s]] to %d entries", "concept", "entry_count"),
        each(8, superseded_candidates(diary, start, end), "mark %s superseded by %s? (%s → %s)", "older_id", "newer_id", "old_entity", "new_entity"),
        counted(9, type_suggestions(diary), "set type of %d unknown-type entities"),
        each(10, insights(diary, start, end), "consider insight: %s", "kind"),
    ]
    return reduce(DataFrame.unionByName, parts)


def entries_without_mood(diary: Diary) -> DataFrame:
    return diary.entries.where("mood is null").select("id", first_line(F.col("body"), 80).alias("first_line"))


def reflect(diary: Diary, start: str, end: str) -> dict[str, DataFrame]:
    """All sections of the report, each a plan of its own."""
    return {
        "unknown_type_entities": unknown_types(diary), "orphan_entities": orphans(diary), "broken_wikilinks": broken_links(diary),
        "entries_without_links": entries_without_links(diary), "entries_without_mood": entries_without_mood(diary), "mood_without_intensity": moods_without_intensity(diary), "days_without_checkin": days_without_checkin(diary),
        "alias_candidates": alias_candidates(diary.entities), "mood_distribution": mood_distribution(diary.entries, start, end), "mood_stats": mood_stats(diary.entries, start, end), "health_stats": health_stats(diary.daily_meta, start, end),
        "insight_candidates": insights(diary, start, end), "missing_emotional_relation": missing_relations(diary), "relation_summary": relation_summary(diary, start, end),
        "tags_to_convert": unconverted_tags(diary), "concept_bridges": concept_bridges(diary, start, end), "superseded_candidates": superseded_candidates(diary, start, end),
        "entity_type_suggestions": type_suggestions(diary), "suggested_actions": suggested_actions(diary, start, end),
    }
