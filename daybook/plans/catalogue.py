"""Queries of the engine over the bound tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import analysis, checkins, claims, merging, search
from ..operators.tables import Diary
from ..sources import sections, segments, storage, vault
from . import views

START, END = "1998-01-01", "1998-06-30"
QUERY = "the thing erntha tion"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_diary: bool = True, ahead: str | None = None):
    """Register f(diary), or f(spark, sf_dir) without with_diary; ahead: the SQL views that sql needs."""

    def register(f):
        QUERIES[name] = (lambda spark, sf_dir: f(views.diary(spark, sf_dir))) if with_diary else f
        if sql:
            SQL[name] = f"WITH {ahead or (views.SQL_VIEWS if with_diary else views.SQL_TOKENS)} {sql}"
        return f

    return register


def joined(c: str):
    return F.array_join(c, ",").alias(c)


_IN = f"date BETWEEN '{START}' AND '{END}'"
_MID = dates.middle(START, END)
_TREND = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'insufficient_data' WHEN abs({b} - {a}) < 0.25 THEN 'flat' WHEN {b} > {a} THEN 'rising' ELSE 'falling' END"


def _trend(c: str, mid: str = _MID) -> str:
    return _TREND.format(a=f"avg(CASE WHEN date < '{mid}' THEN {c} END)", b=f"avg(CASE WHEN date >= '{mid}' THEN {c} END)")


@query("b1_entries_in_range", f"SELECT id, date, mood, intensity FROM entries WHERE {_IN}")
def _(d: Diary):
    return d.entries.where(dates.in_range(F.col("date"), START, END)).select("id", "date", "mood", "intensity")


@query("c1_links_of_entries", f"SELECT entry_id, target, date FROM links JOIN entries ON id = entry_id WHERE {_IN}")
def _(d: Diary):
    return analysis.links_in_range(d, START, END).select("entry_id", "target", "date")


@query("c2_related_entries", f"SELECT DISTINCT e.id FROM relations r JOIN entries e ON e.id = r.entry_id WHERE rel_type = 'joy' AND {_IN}")
def _(d: Diary):
    return search.related_entries(d, None, "joy", START, END)


@query("c5_entity_mentions", "SELECT e.name, e.type, CAST(count(l.target) AS BIGINT) AS mentions FROM entities e LEFT JOIN links l ON l.target = e.name GROUP BY e.name, e.type")
def _(d: Diary):
    return search.with_mentions(d.entities, d.links).select("name", "type", "mentions")


@query("c6_target_pairs", """, p AS (SELECT a.target AS a, b.target AS b, a.entry_id FROM links a JOIN links b ON a.entry_id = b.entry_id AND a.target < b.target)
    SELECT a, b, n, entry_id FROM (SELECT *, CAST(count(*) OVER (PARTITION BY a, b) AS BIGINT) AS n FROM p) WHERE n >= 4""")
def _(d: Diary):
    return analysis.pair_evidence(d)


@query("c8_entries_without_links", "SELECT id, file, regexp_extract(body, '^[^\n]*') AS first_line FROM entries WHERE NOT EXISTS (SELECT 1 FROM links WHERE entry_id = id)")
def _(d: Diary):
    return analysis.entries_without_links(d)


@query("c8_entries_without_mood", "SELECT id, regexp_extract(body, '^[^\n]*') AS first_line FROM entries WHERE mood IS NULL")
def _(d: Diary):
    return analysis.entries_without_mood(d)


@query("c9_missing_relations", """SELECT id, date, mood, intensity, regexp_extract(body, '^[^\n]*') AS first_line FROM entries WHERE (intensity >= 4 OR intensity <= 2) AND NOT EXISTS (SELECT 1 FROM relations WHERE entry_id = id)
    ORDER BY date DESC, ordinal DESC, id LIMIT 50""")
def _(d: Diary):
    return analysis.missing_relations(d)


@query("c10_days_without_checkin", "SELECT DISTINCT date FROM entries WHERE date NOT IN (SELECT date FROM daily WHERE sleep_hours IS NOT NULL OR exercise IS NOT NULL OR mood_score IS NOT NULL)")
def _(d: Diary):
    return analysis.days_without_checkin(d)


@query("c11_orphan_entities", "SELECT name FROM entities WHERE lower(name) NOT IN (SELECT target_key FROM links)")
def _(d: Diary):
    return analysis.orphans(d).select("name")


@query("c12_broken_links", "SELECT target, min(entry_id) AS entry_id FROM links WHERE target_key NOT IN (SELECT lower(name) FROM entities) GROUP BY target")
def _(d: Diary):
    return analysis.broken_links(d)


@query("c14_typed_entries", f"SELECT DISTINCT e.id FROM links l JOIN entries e ON e.id = l.entry_id WHERE {_IN} AND target_key IN (SELECT lower(name) FROM entities WHERE type = 'economy')")
def _(d: Diary):
    return search.typed_entries(d, "Economy", START, END)


@query("c15_type_suggestions", """SELECT name, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS verbs, 'person' AS suggested, 'Target of a "' || min(rel_type) || '::" emotional relation → likely a person.' AS reason
    FROM entities JOIN relations ON target_key = lower(name) WHERE type = 'unknown' GROUP BY name""")
def _(d: Diary):
    return analysis.type_suggestions(d).select("name", joined("verbs"), "suggested", "reason")


_SUPERSEDED = """, typed AS (SELECT l.entry_id, l.pos, e.type, e.name, l.target, x.date FROM plinks l JOIN pentities e ON e.name = l.target JOIN entries x ON x.id = l.entry_id WHERE e.type = 'economy'),
    near AS (SELECT a.entry_id AS older_id, b.entry_id AS newer_id, list(a.target) AS shared, arg_min(a.target, (a.pos, a.target)) AS shared_context FROM plinks a JOIN plinks b ON a.target = b.target JOIN entries x ON x.id = a.entry_id JOIN entries y ON y.id = b.entry_id
        WHERE date_diff('day', CAST(x.date AS DATE), CAST(y.date AS DATE)) >= 7 AND a.entry_id NOT IN (SELECT entry_id FROM old) GROUP BY 1, 2),
    p AS (SELECT n.*, a.type, a.name AS old_entity, b.name AS new_entity, row_number() OVER (PARTITION BY older_id, newer_id ORDER BY a.pos, a.name, b.pos, b.name) AS nth
        FROM near n JOIN typed a ON a.entry_id = older_id JOIN typed b ON b.entry_id = newer_id AND a.target <> b.target
        WHERE NOT EXISTS (SELECT 1 FROM plinks l WHERE l.entry_id = newer_id AND l.target = a.target) AND NOT EXISTS (SELECT 1 FROM plinks l WHERE l.entry_id = older_id AND l.target = b.target))"""


@query("c17_superseded_candidates", f"{_SUPERSEDED} SELECT older_id, newer_id, type, old_entity, new_entity, shared_context FROM p WHERE nth = 1", with_diary=False, ahead=f"{views.SQL_VIEWS}, {views.SQL_PARTS}")
def _(spark: SparkSession, sf_dir: str):
    return analysis.superseded_candidates(views.diary_of_parts(spark, sf_dir), dates.FIRST, dates.LAST, types=["economy"], limit=None)


_JW = "floor(jaro_winkler_similarity(lower(x.name), lower(y.name)) * 1000 + 0.5) / 1000"


@query("c18_alias_candidates", f"""SELECT x.name AS a, y.name AS b, {_JW} AS similarity, 'Possible same entity — review and `entity merge` if so.' AS hint
    FROM (SELECT DISTINCT p_name AS name FROM part) x JOIN (SELECT DISTINCT p_name AS name FROM part) y ON x.name < y.name WHERE jaro_winkler_similarity(lower(x.name), lower(y.name)) >= 0.85""", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    return analysis.alias_candidates(views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("c25_moods_without_relation", """SELECT e.id, e.date, e.ordinal, e.mood FROM entries e WHERE e.mood IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.entry_id = e.id AND r.rel_type IN ('joy', 'trigger', 'with', 'eases'))""")
def _(d: Diary):
    return analysis.moods_without_relation(d).select("id", "date", "ordinal", "mood")


@query("c25_tagged_without_links", " SELECT id, name AS date FROM notes WHERE tags IS NOT NULL AND links IS NULL", with_diary=False, ahead=views.SQL_NOTES)
def _(spark: SparkSession, sf_dir: str):
    return analysis.tagged_without_links(vault.tables(views.note_files(spark, sf_dir))).select("id", "date")


@query("c13_unconverted_tags", """, t AS (SELECT tag, CAST(count(*) AS BIGINT) AS n FROM tags WHERE tag_key NOT IN (SELECT lower(name) FROM entities) GROUP BY tag ORDER BY n DESC, tag LIMIT 30),
    x AS (SELECT tag, entry_id, row_number() OVER (PARTITION BY tag ORDER BY entry_id) AS nth FROM (SELECT DISTINCT tag, entry_id FROM tags WHERE tag IN (SELECT tag FROM t)))
    SELECT t.tag, t.n, string_agg(entry_id, ',' ORDER BY nth) AS examples FROM t JOIN x ON x.tag = t.tag WHERE nth <= 3 GROUP BY t.tag, t.n""")
def _(d: Diary):
    return analysis.unconverted_tags(d).select("tag", "n", joined("examples"))


@query("c24_concept_bridges", f""", t AS (SELECT DISTINCT tag_key, t.entry_id FROM tags t JOIN entries e ON e.id = t.entry_id WHERE {_IN} AND tag_key NOT IN (SELECT lower(name) FROM entities)),
    w AS (SELECT tag_key, arg_min(tag, (-n, tag)) AS concept FROM (SELECT tag_key, tag, count(*) AS n FROM tags t JOIN entries e ON e.id = t.entry_id WHERE {_IN} GROUP BY ALL) GROUP BY tag_key),
    l AS (SELECT t.*, EXISTS (SELECT 1 FROM links l WHERE l.entry_id = t.entry_id AND l.target_key = t.tag_key) AS linked, row_number() OVER (PARTITION BY tag_key ORDER BY t.entry_id) AS nth FROM t)
    SELECT concept, CAST(count(*) AS BIGINT) AS entry_count, string_agg(entry_id, ',' ORDER BY nth) FILTER (WHERE nth <= 5) AS evidence FROM l JOIN w USING (tag_key)
    GROUP BY tag_key, concept HAVING count(*) >= 3 AND 2 * count(*) FILTER (WHERE linked) <= count(*) ORDER BY 2 DESC, 1 LIMIT 10""")
def _(d: Diary):
    return analysis.concept_bridges(d, START, END).select("concept", "entry_count", joined("evidence"))


@query("d2_mood_distribution", f"SELECT mood, CAST(count(*) AS BIGINT) AS n FROM entries WHERE {_IN} AND mood IS NOT NULL GROUP BY mood")
def _(d: Diary):
    return analysis.mood_distribution(d.entries, START, END)


@query("d4_checkin_days", "SELECT CAST(count(*) AS BIGINT) AS days_logged, floor(avg(sleep_hours) * 10 + 0.5) / 10 AS avg_sleep FROM daily")
def _(d: Diary):
    return analysis.checkin_days(d.daily_meta)


@query("d5_active_entities", f"SELECT target AS name, CAST(count(*) AS BIGINT) AS mentions FROM links JOIN entries ON id = entry_id WHERE {_IN} GROUP BY target ORDER BY mentions DESC, name LIMIT 5")
def _(d: Diary):
    return analysis.active_entities(d, START, END)


_SPIKES = """SELECT target, CAST(sum(CASE WHEN date >= '1996-06-01' THEN 1 ELSE 0 END) AS BIGINT) AS period_n, CAST(sum(CASE WHEN date < '1996-06-01' THEN 1 ELSE 0 END) AS BIGINT) AS base_n
    FROM links JOIN entries ON id = entry_id GROUP BY target HAVING period_n >= 4 AND base_n > 0 AND period_n >= 3 * base_n"""


@query("d8_spikes", f"SELECT s.*, entry_id FROM ({_SPIKES}) s JOIN links l ON l.target = s.target JOIN entries e ON e.id = l.entry_id WHERE date >= '1996-06-01'")
def _(d: Diary):
    return analysis.spike_evidence(d, "1996-06-01", "9999-12-31").select("target", "period_n", "base_n", "entry_id")


_SILENCES = """SELECT target, max(date) AS last_date, CAST(count(*) AS BIGINT) AS n, date_diff('day', CAST(max(date) AS DATE), DATE '{end}') AS gap,
    array_to_string(list_slice(list(entry_id ORDER BY date DESC, ordinal DESC, entry_id), 1, 3), ',') AS evidence
    FROM links JOIN entries ON id = entry_id GROUP BY target HAVING count(*) >= 3 AND date_diff('day', CAST(max(date) AS DATE), DATE '{end}') >= 60"""


@query("d9_silences", _SILENCES.format(end="2001-12-31"))
def _(d: Diary):
    return analysis.silences(d, "2001-12-31").select("target", "last_date", "n", F.col("gap").cast("long").alias("gap"), joined("evidence"))


@query("d10_relation_summary", f"""SELECT * FROM (SELECT rel_type, row_number() OVER (PARTITION BY rel_type ORDER BY sum(n) DESC, arg_min(target, (-n, target))) AS nth, arg_min(target, (-n, target)) AS target, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT rel_type, target_key, target, count(*) AS n FROM relations JOIN entries ON id = entry_id WHERE {_IN} AND rel_type IN ('joy', 'trigger') GROUP BY ALL) GROUP BY rel_type, target_key) WHERE nth <= 5""")
def _(d: Diary):
    return analysis.relation_summary(d, START, END).withColumn("nth", F.col("nth").cast("long"))


@query("d13_mood_stats", f"SELECT CAST(count(*) AS BIGINT) AS n, floor(avg(intensity) * 10 + 0.5) / 10 AS avg_intensity, {_trend('intensity')} AS trend FROM entries WHERE {_IN} AND mood IS NOT NULL")
def _(d: Diary):
    return analysis.mood_stats(d.entries, START, END)


_HEALTH = dates.middle("2000-01-01", "2030-12-31")


@query("d14_health_stats", f"""SELECT floor(avg(sleep_hours) * 10 + 0.5) / 10 AS avg_sleep, CAST(count(*) FILTER (WHERE trim(exercise) <> '') AS BIGINT) AS exercise_days, {_trend('mood_score', _HEALTH)} AS mood_score_trend
    FROM daily WHERE date BETWEEN '2000-01-01' AND '2030-12-31'""")
def _(d: Diary):
    return analysis.health_stats(d.daily_meta, "2000-01-01", "2030-12-31")


@query("e2_newest_linked_entries", "SELECT name, id FROM (SELECT l.target AS name, e.id, row_number() OVER (PARTITION BY l.target ORDER BY date DESC, ordinal DESC, e.id) AS nth FROM links l JOIN entries e ON e.id = l.entry_id JOIN entities n ON n.name = l.target) WHERE nth <= 20")
def _(d: Diary):
    return search.linked_entries(d, d.entities)


_STREAK = f"""days AS (SELECT date, avg(intensity) AS v FROM entries WHERE {_IN} AND intensity IS NOT NULL GROUP BY date),
    m AS (SELECT date, CASE WHEN v < lag(v) OVER (ORDER BY date) AND date_diff('day', CAST(lag(date) OVER (ORDER BY date) AS DATE), CAST(date AS DATE)) = 1 THEN 0 ELSE 1 END AS s FROM days),
    r AS (SELECT date, sum(s) OVER (ORDER BY date) AS run FROM m),
    b AS (SELECT run, count(*) AS n, min(date) AS a, max(date) AS z FROM r GROUP BY run HAVING count(*) >= 4 ORDER BY n DESC, run LIMIT 1)
    SELECT 'mood_streak' AS kind, 'Intensity declined ' || n || ' days in a row (' || a || ' → ' || z || ').' AS detail, (SELECT string_agg(date, ',' ORDER BY date) FROM r WHERE r.run = b.run) AS evidence FROM b"""


@query("e3_mood_streak", ", " + _STREAK.replace(_IN, "date BETWEEN '1995-01-01' AND '2001-12-31'"))
def _(d: Diary):
    return analysis.mood_streak(d, "1995-01-01", "2001-12-31").select("kind", "detail", joined("evidence"))


@query("l6_entity_list", "SELECT name, type, CAST((SELECT count(*) FROM links WHERE target = name) AS BIGINT) AS mentions FROM entities")
def _(d: Diary):
    return analysis.entity_list(d).select("name", "type", "mentions")


_FIRST = "regexp_extract(body, '^[^\n]*')"


@query("l2_digest", f""", m AS (SELECT mood, count(*) AS n FROM entries WHERE {_IN} AND mood IS NOT NULL GROUP BY mood),
    a AS (SELECT target, count(*) AS n FROM links JOIN entries ON id = entry_id WHERE {_IN} GROUP BY target ORDER BY n DESC, target LIMIT 5),
    r AS (SELECT * FROM entries WHERE {_IN} ORDER BY date DESC, ordinal DESC, id LIMIT 5)
    SELECT (SELECT string_agg(mood || '=' || n, ',' ORDER BY mood) FROM m) AS distribution, (SELECT floor(avg(intensity) * 10 + 0.5) / 10 FROM entries WHERE {_IN} AND mood IS NOT NULL) AS avg_intensity,
    (SELECT count(*) FROM daily WHERE {_IN}) AS days_logged, (SELECT floor(avg(sleep_hours) * 10 + 0.5) / 10 FROM daily WHERE {_IN}) AS avg_sleep,
    (SELECT string_agg(target || '=' || n, ',' ORDER BY n DESC, target) FROM a) AS active, (SELECT string_agg(id || ' ' || {_FIRST}, ',' ORDER BY id) FROM r) AS recent""")
def _(d: Diary):
    pair = lambda x, k, v: F.concat(x[k], F.lit("="), x[v].cast("string"))
    return analysis.digest(d, START, END).select(
        F.array_join(F.array_sort(F.transform(F.map_entries("distribution"), lambda x: pair(x, "key", "value"))), ",").alias("distribution"), "avg_intensity", "days_logged", "avg_sleep",
        F.array_join(F.transform("active_entities", lambda x: pair(x, "name", "mentions")), ",").alias("active"),
        F.array_join(F.transform(F.array_sort(F.transform("recent_entries", lambda x: F.struct(x["id"].alias("id"), x["first_line"].alias("line")))), lambda x: F.concat_ws(" ", x["id"], x["line"])), ",").alias("recent"),
    )


def _insights_sql(start: str, end: str) -> str:
    inside = f"date BETWEEN '{start}' AND '{end}'"
    streak = _STREAK.replace(_IN, inside)
    at = streak.rindex("SELECT 'mood_streak'")
    return f""", {streak[:at].rstrip()}, streak AS ({streak[at:]}),
    pe AS (SELECT a.target AS a, b.target AS b, a.entry_id, count(*) OVER (PARTITION BY a.target, b.target) AS n, row_number() OVER (PARTITION BY a.target, b.target ORDER BY a.entry_id) AS nth
        FROM links a JOIN links b ON a.entry_id = b.entry_id AND a.target < b.target JOIN entries e ON e.id = a.entry_id WHERE {inside}),
    sp AS (SELECT target, sum(CASE WHEN {inside} THEN 1 ELSE 0 END) AS p, sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS q FROM links JOIN entries ON id = entry_id GROUP BY target HAVING p >= 4 AND q > 0 AND p >= 3 * q),
    se AS (SELECT sp.*, entry_id, row_number() OVER (PARTITION BY sp.target ORDER BY date DESC, ordinal DESC, entry_id) AS nth FROM sp JOIN links l ON l.target = sp.target JOIN entries ON id = entry_id WHERE {inside}),
    si AS ({_SILENCES.format(end=end)}),
    ins AS (SELECT 0 AS part, * FROM streak UNION ALL
    SELECT 1, 'co_occurrence', '[[' || a || ']] and [[' || b || ']] appeared together ' || n || ' times.', string_agg(entry_id, ',' ORDER BY nth) FILTER (WHERE nth <= 100) FROM pe WHERE n >= 4 GROUP BY a, b, n UNION ALL
    SELECT 2, 'entity_spike', '[[' || target || ']] mentioned ' || p || '× this period vs ' || q || '× before (spike).', string_agg(entry_id, ',' ORDER BY nth) FILTER (WHERE nth <= 100) FROM se GROUP BY target, p, q UNION ALL
    SELECT 3, 'silence', '[[' || target || ']] (frequent before) not mentioned for ' || gap || ' days; last on ' || last_date || '.', evidence FROM si)"""


@query("g0_insights", _insights_sql("1996-06-01", "2001-12-31") + " SELECT part, kind, detail, evidence FROM ins")
def _(d: Diary):
    return analysis.insights(d, "1996-06-01", "2001-12-31").select("part", "kind", "detail", joined("evidence"))


@query("l3_suggested_actions", _insights_sql(START, END) + f""", tagged AS (SELECT DISTINCT tag_key, t.entry_id FROM tags t JOIN entries e ON e.id = t.entry_id WHERE {_IN} AND tag_key NOT IN (SELECT lower(name) FROM entities)),
    spelled AS (SELECT tag_key, arg_min(tag, (-n, tag)) AS concept FROM (SELECT tag_key, tag, count(*) AS n FROM tags t JOIN entries e ON e.id = t.entry_id WHERE {_IN} GROUP BY ALL) GROUP BY tag_key),
    flagged AS (SELECT t.*, EXISTS (SELECT 1 FROM links l WHERE l.entry_id = t.entry_id AND l.target_key = t.tag_key) AS linked FROM tagged t),
    bridges AS (SELECT concept, count(*) AS n FROM flagged JOIN spelled USING (tag_key) GROUP BY tag_key, concept HAVING count(*) >= 3 AND 2 * count(*) FILTER (WHERE linked) <= count(*) ORDER BY 2 DESC, 1 LIMIT 10),
    counts AS (SELECT 1 AS priority, count(*) AS n, 'classify % unknown-type entities' AS t FROM entities WHERE type = 'unknown'
        UNION ALL SELECT 2, count(*), 'review % possible alias pairs' FROM entities x JOIN entities y ON x.name < y.name WHERE jaro_winkler_similarity(lower(x.name), lower(y.name)) >= 0.85
        UNION ALL SELECT 3, count(DISTINCT target), 'fix % broken wikilinks' FROM links WHERE target_key NOT IN (SELECT lower(name) FROM entities)
        UNION ALL SELECT 4, count(*), 'backfill links on % entries' FROM entries WHERE NOT EXISTS (SELECT 1 FROM links WHERE entry_id = id)
        UNION ALL SELECT 5, least(count(*), 50), 'backfill emotional relation on % strong-mood entries' FROM entries WHERE (intensity >= 4 OR intensity <= 2) AND NOT EXISTS (SELECT 1 FROM relations WHERE entry_id = id)
        UNION ALL SELECT 6, least(count(DISTINCT tag), 30), 'convert % tags to wikilinks/relations' FROM tags WHERE tag_key NOT IN (SELECT lower(name) FROM entities)
        UNION ALL SELECT 9, count(*), 'set type of % unknown-type entities' FROM entities WHERE type = 'unknown' AND lower(name) IN (SELECT target_key FROM relations WHERE rel_type IN ('with', 'joy', 'trigger', 'eases')))
    SELECT CAST(priority AS INTEGER) AS priority, replace(t, '%', CAST(n AS VARCHAR)) AS action FROM counts WHERE n > 0
    UNION ALL SELECT 7, 'add [[' || concept || ']] to ' || n || ' entries' FROM bridges
    UNION ALL SELECT 10, 'consider insight: ' || kind FROM ins""")
def _(d: Diary):
    return analysis.suggested_actions(d, START, END)


@query("l1_recall_by_relation", f"""SELECT e.id, e.date, 0.5 AS score FROM entries e WHERE {_IN} AND e.id IN (SELECT entry_id FROM relations WHERE rel_type = 'joy')
    ORDER BY e.id IN (SELECT entry_id FROM old), date DESC, ordinal DESC, id LIMIT 10""", with_diary=False, ahead=views.SQL_VIEWS)
def _(spark: SparkSession, sf_dir: str):
    return search.recall(views.diary(spark, sf_dir), views.index_of(spark, sf_dir, "entries"), relation="joy", start=START, end=END).select("id", "date", "score")


_TYPED = "e.id IN (SELECT l.entry_id FROM links l WHERE l.target_key IN (SELECT lower(name) FROM entities WHERE type = 'economy'))"


@query("l1_recall_by_type", f"""SELECT e.id, e.date, 0.3 AS score, t.total FROM entries e, (SELECT CAST(count(*) AS BIGINT) AS total FROM entries e WHERE {_IN} AND {_TYPED}) t WHERE {_IN} AND {_TYPED}
    ORDER BY e.id IN (SELECT entry_id FROM old), date DESC, ordinal DESC, id LIMIT 10""", with_diary=False, ahead=views.SQL_VIEWS)
def _(spark: SparkSession, sf_dir: str):
    return search.recall(views.diary(spark, sf_dir), views.index_of(spark, sf_dir, "entries"), kind="Economy", start=START, end=END).select("id", "date", "score", "total")


@query("l1_recall_by_relation_and_type", f"""SELECT e.id, e.date, 0.5 AS score, regexp_extract(body, '^[^\n]*') || ' ' || mood_ AS snippet FROM (SELECT *, coalesce(mood, 'P') AS mood_ FROM entries) e WHERE {_IN} AND {_TYPED} AND e.id IN (SELECT entry_id FROM relations WHERE rel_type = 'joy')
    ORDER BY e.id IN (SELECT entry_id FROM old), date DESC, ordinal DESC, id LIMIT 25""", with_diary=False, ahead=views.SQL_VIEWS)
def _(spark: SparkSession, sf_dir: str):
    """Two filters at once, with the snippet of each entry."""
    found = search.recall(views.diary(spark, sf_dir), views.index_of(spark, sf_dir, "entries"), relation="joy", kind="economy", start=START, end=END, limit=25)
    return found.select("id", "date", "score", "snippet")


def _terms(q: str) -> list[tuple[int, str, bool]]:
    toks = text.query_tokens(q)
    return [(i, t, i == len(toks) - 1 and len(t) >= text.MIN_PREFIX) for i, t in enumerate(toks)]


def _hits(t: str, prefix: bool) -> str:
    return f"len(list_filter(t, lambda x: starts_with(x, '{t}')))" if prefix else f"len(list_filter(t, lambda x: x = '{t}'))"


def _bm25_sql(q: str) -> str:
    f = ", ".join(f"{_hits(t, p)} AS f{i}" for i, t, p in _terms(q))
    part = "(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * ln_ / av))"
    total = " + ".join(part.format(i=i) for i, _, _ in _terms(q))
    some = " OR ".join(f"f{i} > 0" for i, _, _ in _terms(q))
    counts = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i, _, _ in _terms(q))
    return f", c AS (SELECT id, t, len(t) AS ln_, {f} FROM docs), s AS (SELECT count(*) AS n, avg(ln_) AS av, {counts} FROM c), scored AS (SELECT id, t, {total} AS score FROM c, s WHERE {some})"


def _full_text_sql(q: str) -> str:
    counted, least = text.coverage_rule(text.query_tokens(q))
    cover = " + ".join(f"CASE WHEN {_hits(t, p)} > 0 THEN 1 ELSE 0 END" for i, t, p in _terms(q) if i in counted)
    return _bm25_sql(q) + f", top AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, id LIMIT 80), hits AS (SELECT id, score FROM top WHERE {cover} >= {least} ORDER BY round(score, 9) DESC, id LIMIT 20)"


def _recall_sql(q: str, alias: str, weight: float) -> str:
    run = " ".join(text.query_tokens(q))
    return f", {views.SQL_ENTRY_TOKENS} " + _full_text_sql(q) + f""", ph AS (SELECT id FROM docs WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' {run} ') ORDER BY id LIMIT 50),
    who AS (SELECT name FROM entities WHERE alias = '{alias}'), rel AS (SELECT DISTINCT entry_id AS id FROM relations WHERE target IN (SELECT name FROM who)),
    lnk AS (SELECT id FROM (SELECT e.id, row_number() OVER (PARTITION BY l.target ORDER BY date DESC, ordinal DESC, e.id) AS nth FROM links l JOIN entries e ON e.id = l.entry_id WHERE l.target IN (SELECT name FROM who)) WHERE nth <= 20),
    parts AS (SELECT id, score / (SELECT max(score) FROM hits) + CASE WHEN id IN (SELECT id FROM ph) THEN 0.2 ELSE 0 END AS score FROM hits UNION ALL SELECT id, 0.5 FROM rel UNION ALL SELECT id, 0.3 FROM lnk),
    merged AS (SELECT id, floor(sum(score) * 1000 + 0.5) / 1000 AS score FROM parts GROUP BY id),
    ranked AS (SELECT m.*, CAST(row_number() OVER (ORDER BY m.score * CASE WHEN o.entry_id IS NULL THEN 1 ELSE {weight} END DESC, o.entry_id IS NOT NULL, date DESC, ordinal DESC, m.id) AS INTEGER) AS place, o.newer_id AS superseded
        FROM merged m JOIN entries e ON e.id = m.id LEFT JOIN old o ON o.entry_id = m.id)
    SELECT r.id, place, score, (SELECT count(*) FROM merged) AS total, e.date, e.mood, e.body, superseded, (SELECT string_agg(target, ',' ORDER BY pos, target) FROM links l WHERE l.entry_id = r.id) AS links,
    (SELECT string_agg(tag, ',' ORDER BY pos, tag) FROM tags t WHERE t.entry_id = r.id) AS tags, (SELECT string_agg(v, ';' ORDER BY v) FROM (SELECT rel_type || '=' || string_agg(target, ',' ORDER BY target) AS v FROM relations x WHERE x.entry_id = r.id GROUP BY rel_type)) AS relations
    FROM ranked r JOIN entries e ON e.id = r.id WHERE place <= 10"""


def _recalled(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    found = search.recall(views.diary(spark, sf_dir), views.index_of(spark, sf_dir, "entries"), query=q, entity="s7")
    empty = lambda c: F.when(c != "", c)
    verbs = F.transform(F.map_entries("relations"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ",")))
    return found.select("id", "place", "score", "total", "date", "mood", "body", "superseded", empty(F.array_join("links", ",")).alias("links"), empty(F.array_join("tags", ",")).alias("tags"), empty(F.array_join(F.array_sort(verbs), ";")).alias("relations"))


@query("l1_recall", _recall_sql("1-urgent f", "s7", 1.0), with_diary=False, ahead=views.SQL_VIEWS)
def _(spark: SparkSession, sf_dir: str):
    return _recalled(spark, sf_dir, "1-urgent f")


@query("l1_recall_of_now", _recall_sql("now 4-not specified p", "s7", 0.5), with_diary=False, ahead=views.SQL_VIEWS)
def _(spark: SparkSession, sf_dir: str):
    return _recalled(spark, sf_dir, "now 4-not specified p")


@query("i3_bm25", _bm25_sql(QUERY) + " SELECT id, round(score, 6) AS score FROM scored", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    return search.bm25(views.index_of(spark, sf_dir), QUERY).select("id", F.round("score", 6).alias("score"))


@query("i5_full_text_gated", _full_text_sql(QUERY) + " SELECT id, round(score, 6) AS score FROM hits", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    return search.full_text(views.index_of(spark, sf_dir), QUERY).select("id", F.round("score", 6).alias("score"))


@query("i4_phrase", " SELECT id FROM docs WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') ORDER BY id LIMIT 50", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    return search.phrase(views.index_of(spark, sf_dir), "of the")


@query("h1_fold", ", f AS (SELECT doc_id, lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')) AS x FROM documents) SELECT doc_id, sha256(x) AS folded FROM f", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    return views.read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("h2_tokens", " SELECT id, CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(t, ' ')) AS digest FROM docs", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    t = views.corpus(spark, sf_dir).select("id", text.tokens(F.col("body")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


_MERGED = """move AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 16 <> 0 THEN s_suppkey - 1 ELSE s_suppkey + 15 END AS into_ FROM supplier WHERE s_suppkey % 16 <> 0 OR s_suppkey // 16 % 4 = 2),
    m AS (SELECT move.k, into_ FROM move JOIN supplier ON s_suppkey = into_), walk AS (SELECT k, into_ AS stop FROM m UNION SELECT walk.k, m.into_ FROM walk JOIN m ON walk.stop = m.k),
    ends AS (SELECT k, stop FROM walk WHERE stop NOT IN (SELECT k FROM m)), named AS (SELECT a.s_name AS name, b.s_name AS target FROM ends JOIN supplier a ON a.s_suppkey = k JOIN supplier b ON b.s_suppkey = stop)"""



@query("l7_merge_suppliers", f""" SELECT coalesce(target, s_name) AS name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS entries FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN named ON named.name = s_name GROUP BY 1""", with_diary=False, ahead="RECURSIVE " + _MERGED)
def _(spark: SparkSession, sf_dir: str):
    """Suppliers merged in chains of up to sixteen, some in circles that are left alone: lines and orders of each."""
    suppliers, lines = views.read(spark, sf_dir, "supplier"), views.read(spark, sf_dir, "lineitem")
    resolved = merging.resolve(spark, _supplier_moves(suppliers))
    sold = lines.join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name")), "l_suppkey").select("l_orderkey", "name")
    return merging.redirect_column(sold, resolved, "name").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("entries"))


def _supplier_moves(suppliers: DataFrame) -> DataFrame:
    """Each supplier into the one before it, but for every sixteenth; some of these into the last of their sixteen."""
    key, name = F.col("s_suppkey"), F.col("s_name")
    into = F.when(key % 16 != 0, key - 1).when(F.floor(key / 16) % 4 == 2, key + 15)
    moves = suppliers.select(name.alias("source"), into.alias("k")).where("k is not null")
    return moves.join(suppliers.select(key.alias("k"), name.alias("into")), "k").select("source", "into")


@query("g5_merged_aliases", """ SELECT s_name AS name, coalesce(string_agg(name, ',' ORDER BY name), '') AS aliases FROM supplier LEFT JOIN named ON target = s_name WHERE s_name NOT IN (SELECT name FROM named) GROUP BY s_name""", with_diary=False, ahead="RECURSIVE " + _MERGED)
def _(spark: SparkSession, sf_dir: str):
    """The suppliers that are left, with the names of those merged into them."""
    suppliers = views.read(spark, sf_dir, "supplier")
    entities = suppliers.select(F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return merging.merged_aliases(entities, merging.resolve(spark, _supplier_moves(suppliers))).select("name", joined("aliases"))


@query("h8_rewritten_links", """ SELECT CAST(l_orderkey AS VARCHAR) AS id, '[[' || string_agg(coalesce(target, s_name) || '|' || CAST(l_linenumber AS VARCHAR), ']] [[' ORDER BY l_linenumber, s_name) || ']] `[[' || CAST(l_orderkey AS VARCHAR) || ']]`' AS body
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN named ON named.name = s_name GROUP BY l_orderkey HAVING count(target) > 0""", with_diary=False, ahead="RECURSIVE " + _MERGED)
def _(spark: SparkSession, sf_dir: str):
    """Orders as notes that link the suppliers of their lines, with the links to merged ones rewritten."""
    suppliers, lines = views.read(spark, sf_dir, "supplier"), views.read(spark, sf_dir, "lineitem")
    sold = lines.join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").select(F.col("l_orderkey").cast("string").alias("entry_id"), "l_linenumber", F.col("s_name").alias("target"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "target"))), lambda x: F.concat(F.lit("[["), x["target"], F.lit("|"), x["l_linenumber"].cast("string"), F.lit("]]")))
    notes = sold.groupBy(F.col("entry_id").alias("id")).agg(F.array_join(each, " ").alias("links")).select("id", F.concat("links", F.lit(" `[["), "id", F.lit("]]`")).alias("body"))
    return merging.rewritten_bodies(notes, sold, merging.resolve(spark, _supplier_moves(suppliers)))


_FIELDS = ["mood:: calm/3\n", "tags:: red, blue\nwith:: [[Ann]], [[Bob|B]]\n", "superseded:: 2024-01-02#3\n", ""]
_LINES = "lines AS (SELECT id, i, l[i + 1] AS line FROM (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(len(l))) r(i))"


@query("h9_sections", """ SELECT id AS note, CAST(i AS INTEGER) AS ordinal, lpad(CAST(i % 24 AS VARCHAR), 2, '0') || ':30' AS time, CASE WHEN i % 4 = 0 THEN 'calm' END AS mood, CASE WHEN i % 4 = 0 THEN '3' ELSE 'none' END AS intensity,
    CASE WHEN i % 4 = 2 THEN '2024-01-02#3' END AS superseded, CASE WHEN i % 4 = 1 THEN 'red,blue' ELSE '' END AS tags, CASE WHEN i % 4 = 1 THEN 'Ann,Bob' END AS with_, CASE WHEN trim(line) = '' THEN '' ELSE line END AS text FROM lines""", with_diary=False, ahead=_LINES)
def _(spark: SparkSession, sf_dir: str):
    """Every line of every document as a section of its note, under a heading and fields of four kinds."""
    block = lambda x, i: F.concat(F.lit("## "), F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":30\n"), F.get(F.array(*map(F.lit, _FIELDS)), i % 4), x)
    notes = views.corpus(spark, sf_dir).select(F.col("id").alias("note"), F.array_join(F.transform(F.split("body", "\n", -1), block), "\n\n").alias("body"))
    return sections.sections(notes).select("note", "ordinal", "time", "mood", F.coalesce(F.col("intensity").cast("string"), F.lit("none")).alias("intensity"), "superseded", joined("tags"), F.array_join(F.col("relations")["with"], ",").alias("with_"), "text")


_TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS note, CAST(turn AS BIGINT) AS ordinal, text, list_contains(regexp_split_to_array(lower(replace(replace(strip_accents(coalesce(text, '')), 'đ', 'd'), 'Đ', 'D')), '[^\\p{L}\\p{N}]+'), 'und') AS goes FROM conversations),
    placed AS (SELECT *, ordinal - sum(CASE WHEN goes THEN 1 ELSE 0 END) OVER (PARTITION BY note ORDER BY ordinal) AS now, lead(goes) OVER (PARTITION BY note ORDER BY ordinal) AS next_goes FROM turns)"""


@query("l5_forget_turns", " SELECT note, CAST(now AS BIGINT) AS ordinal, text, CAST(CASE WHEN NOT next_goes THEN now + 1 ELSE -1 END AS BIGINT) AS newer FROM placed WHERE NOT goes", with_diary=False, ahead=_TURNS)
def _(spark: SparkSession, sf_dir: str):
    """Conversations without the turns that name a word; later turns move up, and what refers to the next turn follows it."""
    rows = views.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("note"), F.col("turn").cast("long").alias("ordinal"), "text", (F.col("turn") + 1).cast("long").alias("newer"))
    doomed = rows.where(F.array_contains(text.tokens(F.coalesce("text", F.lit(""))), "und")).select("note", "ordinal")
    return sections.forget_rows(rows, doomed, "newer").withColumn("newer", F.coalesce("newer", F.lit(-1).cast("long")))


_TOLD = ["ngày {d} tháng {m}", "Ngày {d} tháng {m} năm {y}", "{d}/{m}/{y}", "hôm qua", "Hôm kia", "thứ {w} tuần trước", "chủ nhật vừa rồi", "cuối tuần", "tuần trước", "tháng trước", "31/{m}/{y} hôm qua", ""]
_DAY, _MONTH, _YEAR, _WEEK = "doc_id % 31 + 1", "doc_id % 12 + 1", "1990 + doc_id % 40", "doc_id % 6 + 2"


def _told(k: int, concat) -> str:
    return concat([x for part in _TOLD[k].replace("{", "|{").replace("}", "}|").split("|") if (x := part)])


def _sql_told(parts: list[str]) -> str:
    values = {"{d}": _DAY, "{m}": _MONTH, "{y}": _YEAR, "{w}": _WEEK}
    return " || ".join(f"CAST({values[p]} AS VARCHAR)" if p in values else f"'{p}'" for p in parts) or "''"


_DATED = f"""d AS (SELECT doc_id, CAST(DATE '2023-01-01' + CAST(doc_id % 1000 AS INTEGER) AS DATE) AS today, CAST(doc_id % 12 AS INTEGER) AS k, {_DAY} AS d, {_MONTH} AS m, {_YEAR} AS y, {_WEEK} AS w FROM documents),
    x AS (SELECT *, CAST(strftime(TRY_CAST(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d') AS VARCHAR) AS told,
        TRY_CAST(CAST(year(today) AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS this,
        TRY_CAST(CAST(year(today) - 1 AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS last,
        TRY_CAST(CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-31' AS DATE) AS late FROM d),
    r AS (SELECT doc_id, k, CASE k WHEN 0 THEN CASE WHEN this <= today THEN this WHEN this IS NOT NULL THEN last END WHEN 1 THEN CAST(told AS DATE) WHEN 2 THEN CAST(told AS DATE) WHEN 3 THEN today - 1 WHEN 4 THEN today - 2
        WHEN 5 THEN today - CAST((dayofweek(today) - (w - 1) + 6) % 7 + 1 AS INTEGER) WHEN 6 THEN today - CAST((dayofweek(today) + 6) % 7 + 1 AS INTEGER) WHEN 7 THEN today - CAST(dayofweek(today) % 7 + 1 AS INTEGER)
        WHEN 8 THEN today - 7 WHEN 9 THEN CAST(date_trunc('month', today) - INTERVAL 1 MONTH AS DATE) + CAST(day(today) - 1 AS INTEGER) WHEN 10 THEN coalesce(late, today - 1) END AS day FROM x)"""


@query("h27_event_dates", " SELECT doc_id, strftime(day, '%Y-%m-%d') AS day, k = 0 AS guessed FROM r WHERE day IS NOT NULL", with_diary=False, ahead=_DATED)
def _(spark: SparkSession, sf_dir: str):
    """The date that each document tells, relative to a day of its own: a phrase of some kind, then its text."""
    docs = views.read(spark, sf_dir, "documents").withColumn("today", F.expr("date_add(date'2023-01-01', cast(doc_id % 1000 as int))"))
    told = F.expr("CASE " + " ".join(f"WHEN doc_id % 12 = {k} THEN " + _told(k, _sql_told).replace("VARCHAR", "STRING") for k in range(len(_TOLD))) + " END")
    found = F.filter(F.array(dates.event_date(F.concat_ws(" ", told, "text"), F.col("today"))), lambda e: e.isNotNull())
    return docs.select("doc_id", F.inline(found)).drop("phrase")


_BATCHES = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(lower(replace(replace(strip_accents(CASE WHEN doc_id % 3 = 1 THEN 'edited ' ELSE '' END || coalesce(text, '')), 'đ', 'd'), 'Đ', 'D')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t
    FROM documents WHERE doc_id % 5 <> 0)"""


@query("i1_index_in_batches", _bm25_sql("edited " + QUERY) + " SELECT id, round(score, 6) AS score FROM scored", with_diary=False, ahead=_BATCHES)
def _(spark: SparkSession, sf_dir: str):
    """Two thirds of the documents, then the last third and edits of the second, then a fifth taken out."""
    docs = views.corpus(spark, sf_dir)
    third, index = F.col("id").cast("long") % 3, segments.SegmentedIndex(spark, storage.new_path(spark, "segments"), fanout=2)
    index.apply(docs.where(third != 2))
    index.apply(docs.where(third != 0).withColumn("body", F.when(third == 1, F.concat(F.lit("edited "), "body")).otherwise(F.col("body"))))
    index.apply(deletes=docs.where(F.col("id").cast("long") % 5 == 0).select("id"))
    return search.bm25(index.open(), "edited " + QUERY).select("id", F.round("score", 6).alias("score"))


@query("i1_postings", " SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS entries FROM (SELECT id, unnest(t) AS token FROM docs) GROUP BY token", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    return views.index_of(spark, sf_dir).postings.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("entries"))


@query("h31_block_hash", ", b AS (SELECT conv_id, turn, substr(sha256(trim(text)), 1, 16) AS hash FROM conversations) SELECT * FROM b", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.block_hash(F.col("text")).alias("hash"))


@query("e6_import_status", """, b AS (SELECT doc_id, substr(sha256(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))), 1, 16) AS hash FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS nth, hash IN (SELECT substr(sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 1, 16) FROM benchmark) AS logged FROM b)
    SELECT doc_id, hash, CASE WHEN logged THEN 'known' WHEN nth > 1 THEN 'duplicate' ELSE 'new' END AS status FROM r""", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    """Documents as blocks to import, benchmark items as what the log has."""
    key = text.block_hash(F.coalesce("text", F.lit(""))).alias("hash")
    blocks = views.read(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.lit(0).alias("pos"), F.lit("2026-01-01").alias("date"), "doc_id", key)
    return vault.import_status(blocks, views.read(spark, sf_dir, "benchmark").select(key)).select("doc_id", "hash", "status")


@query("a10_snapshot_diff", """, was AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS path, count(*) AS m FROM orders GROUP BY 1), now AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS path, count(DISTINCT l_orderkey) AS m FROM lineitem GROUP BY 1)
    SELECT coalesce(was.path, now.path) AS path, CASE WHEN was.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' WHEN was.m <> now.m THEN 'changed' ELSE 'same' END AS change FROM was FULL OUTER JOIN now ON was.path = now.path""", with_diary=False)
def _(spark: SparkSession, sf_dir: str):
    """Days of orders as stored files, days of shipping as listed ones; their counts stand for times of change."""
    was = views.read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("path")).agg(F.count("*").alias("mtime"))
    now = views.read(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("path")).agg(F.count_distinct("l_orderkey").alias("mtime"))
    return vault.snapshot_diff(was, now)


@query("a5_vault_entries", " SELECT id, name AS date, time, mood, coalesce(CAST(intensity AS VARCHAR), 'none') AS intensity, body, links, tags, relations FROM notes", with_diary=False, ahead=views.SQL_NOTES)
def _(spark: SparkSession, sf_dir: str):
    """The sections of all documents as a vault's notes, through the sources that parse files."""
    d = vault.tables(views.note_files(spark, sf_dir))
    found = search.hydrate(d, d.entries.select("id"))
    verbs = F.transform(F.map_entries("relations"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ",")))
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return found.select("id", "date", "time", "mood", F.coalesce(F.col("intensity").cast("string"), F.lit("none")).alias("intensity"), "body", some(F.col("links")).alias("links"), some(F.col("tags")).alias("tags"), some(verbs).alias("relations"))


@query("a6_vault_entities", """ SELECT 'd' || doc_id AS name, 'thing' AS type, 'a' || doc_id || ',b' AS aliases, NULL AS sleep_hours FROM documents WHERE doc_id % 7 = 0
    UNION ALL SELECT 'd' || doc_id, 'run', 'x', CAST(doc_id % 9 AS DOUBLE) FROM documents WHERE doc_id % 7 <> 0""", with_diary=False, ahead=views.SQL_NOTES)
def _(spark: SparkSession, sf_dir: str):
    """Entities and days of all documents as a vault's notes: what their frontmatter says."""
    d = vault.tables(views.note_files(spark, sf_dir))
    days = d.daily_meta.select(F.col("date").alias("name"), F.col("exercise").alias("type"), F.col("extra")["other"].alias("aliases"), "sleep_hours")
    return d.entities.select("name", "type", joined("aliases"), F.lit(None).cast("double").alias("sleep_hours")).unionByName(days)


@query("c26_new_names", """, m AS (SELECT target, entry_id AS place FROM links UNION ALL SELECT target, entry_id FROM relations UNION ALL SELECT tag, entry_id FROM tags),
    first AS (SELECT lower(target) AS name_key, arg_min(target, (place, target)) AS name FROM m GROUP BY 1)
    SELECT name, name_key, 'unknown' AS type, CAST(0 AS BIGINT) AS again FROM first WHERE name_key NOT IN (SELECT lower(name) FROM entities UNION SELECT lower(alias) FROM entities WHERE alias IS NOT NULL)""", with_diary=False, ahead=views.SQL_VIEWS)
def _(spark: SparkSession, sf_dir: str):
    """Stubs for all link targets, relation targets and tags that are no entity; a second batch of the same claims none."""
    d, path = views.diary(spark, sf_dir), storage.new_path(spark, "stubs")
    named = lambda df, c: df.select(F.col(c).alias("target"), F.col("entry_id").alias("place"))
    mentions = named(d.links, "target").unionByName(named(d.relations, "target")).unionByName(named(d.tags, "tag"))
    mentions = storage.materialise(spark, claims.least_places(mentions), "mentions")  # two batches read it
    first = claims.claim_names(spark, mentions, d.entities, path, "first")
    again = claims.claim_names(spark, mentions, d.entities, path, "second").agg(F.count("*").alias("again"))
    return first.select("name", "name_key", "type").join(F.broadcast(again))


@query("a20_merged_checkins", """, e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_type AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE event_id % 11 <> 0),
    u AS (SELECT day, event_id, key, value FROM e UNION ALL SELECT day, event_id, 'last', '"' || key || '"' FROM e), r AS (SELECT day, key, arg_max(value, (event_id, value)) AS value FROM u GROUP BY day, key)
    SELECT r.*, CAST(n AS BIGINT) AS n_keys FROM r JOIN (SELECT day, count(*) AS n FROM r GROUP BY day) USING (day)""", with_diary=False, ahead="one AS (SELECT 1)")
def _(spark: SparkSession, sf_dir: str):
    """The fields that the events of a day set, the latest value of each; every eleventh text is malformed."""
    value, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    told = F.when(F.col("event_id") % 11 == 0, F.lit('{"k": ')).otherwise(F.concat(F.lit('{"'), kind, F.lit('": '), value, F.lit(', "last": "'), kind, F.lit('"}')))
    rows = views.read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", told.alias("fields"))
    merged = storage.materialise(spark, checkins.merged_fields(rows, "day", "event_id", "fields"), "checkins")
    n = checkins.as_objects(merged, "day").select("day", F.size(F.json_object_keys(F.to_json("fields"))).cast("long").alias("n_keys"))
    return merged.select("day", "key", F.to_json("value").alias("value")).join(n, "day")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a query."""
    return search.full_text(views.index_of(spark, sf_dir), QUERY)
