"""Ranked retrieval: BM25 full text, phrases, entity, relation and type expansion, and their merge.

Full text runs on a stored inverted index: postings (token, entry, frequency, positions) that lie in
buckets by the first characters of their token, so a query reads the buckets and tokens it asks for, and
never the entries' texts.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import in_range
from ..functions.text import MIN_PREFIX, asks_for_now, coverage_rule, fold, query_tokens, round_up, snippet, tokens
from ..sources.storage import materialise
from .tables import Diary, Index

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TOP, OVERFETCH, PHRASE_LIMIT, PER_ENTITY, DEFAULT_LIMIT = 20, 4, 50, 20, 10
PHRASE_BONUS, ENTITY_BONUS, RELATION_BONUS, SUPERSEDED_WEIGHT = 0.2, 0.3, 0.5, 0.5
#: Buckets of the index; a bucket holds all tokens with the same first MIN_PREFIX characters.
BUCKETS = 64
#: Keys that are told to a table as a list of values, so that they are met where it is read; more are joined.
LISTED = 1000
POSTINGS = "token string, entry_id string, tf int, len int, positions array<int>, bucket int"
STATS = "n bigint, avg double"


def _plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def listed(rows: DataFrame, column: str) -> list | None:
    """The distinct values of a column if there are few; nulls are left out, as they equal nothing."""
    found = rows.where(F.col(column).isNotNull()).select(column).distinct().limit(LISTED + 1).collect()
    return [r[0] for r in found] if len(found) <= LISTED else None


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, MIN_PREFIX)), F.lit(BUCKETS)).cast("int")


def postings(entries: DataFrame) -> DataFrame:
    """(token, entry_id, tf, len, positions, bucket): a row for each distinct token of each entry. An entry's
    tokens are grouped within its row, so that nothing is shuffled."""
    t = entries.select(F.col("id").alias("entry_id"), tokens(F.col("body")).alias("t"))
    # Tokens sorted with their places; a token starts a run of its own where it differs from the one before. A run is
    # whole before it becomes a row, so that no row carries its entry's tokens along.
    placed = t.select("entry_id", F.size("t").alias("len"), F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("token"), i.alias("pos")))).alias("s"))
    split = placed.select("entry_id", "len", F.transform("s", lambda x: x["token"]).alias("w"), F.transform("s", lambda x: x["pos"]).alias("at"))
    starts = split.withColumn("first", F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (F.get("w", i - 1) != x), i)), lambda i: i.isNotNull()))
    tf = lambda a, k: F.coalesce(F.get("first", k + 1), F.size("w")) - a
    runs = F.transform("first", lambda a, k: F.struct(F.get("w", a).alias("token"), tf(a, k).alias("tf"), F.slice("at", a + 1, tf(a, k)).alias("positions")))
    rows = starts.select("entry_id", "len", F.explode(runs).alias("r")).select("r.token", "entry_id", "r.tf", "len", "r.positions")
    return rows.withColumn("bucket", bucket_of(F.col("token")))


def build_index(spark: SparkSession, entries: DataFrame, path: str) -> Index:
    """Write the postings of entries (id, body) and the corpus statistics to path. A bucket that is large is split
    among tasks, so there are more tasks where there is more text."""
    rows = postings(entries)
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    total = spark.read.schema(POSTINGS).parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    counted = entries.agg(F.count("*").alias("n")).join(total).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avg"))
    counted.write.mode("overwrite").parquet(f"{path}/stats")
    return open_postings(spark, path)


def open_postings(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(STATS).parquet(f"{path}/stats"))


def matches(index: Index, query_list: list[str]) -> DataFrame:
    """Postings of the query's tokens only: (q, token, entry_id, tf, len, positions), q the token's place in
    the query. The last token also matches as a prefix if it is long enough; repeated tokens match each."""
    last = len(query_list) - 1
    parts = []
    for i, q in enumerate(query_list):
        prefix = i == last and len(q) >= MIN_PREFIX
        own = F.col("token").startswith(q) if prefix else F.col("token") == q
        parts.append(index.postings.where((F.col("bucket") == bucket_of(F.lit(q))) & own).select(F.lit(i).alias("q"), "token", "entry_id", "tf", "len", "positions"))
    return reduce(DataFrame.unionByName, parts)


def bm25(index: Index, query: str, limit: int | None = None) -> DataFrame:
    """id, score of entries with a query token; repeated query tokens count each; higher is better."""
    query_list = query_tokens(query)
    if not query_list:
        return index.postings.where(F.lit(False)).select(F.col("entry_id").alias("id"), F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("found"))
    hits = matches(index, query_list).groupBy("q", "entry_id").agg(F.sum("tf").cast("double").alias("tf"), F.first("len").alias("len"))
    df = hits.groupBy("q").agg(F.count("*").alias("df"))  # a row for each query token
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(index.stats)).select("q", "avg", F.when(idf > 0, idf).otherwise(IDF_FLOOR).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hits.join(F.broadcast(weights), "q").groupBy(F.col("entry_id").alias("id")).agg(F.sum(part).alias("score"), F.collect_set("q").alias("found"))
    return scored if limit is None else scored.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def full_text(index: Index, query: str, limit: int = TOP) -> DataFrame:
    """The best entries that also cover enough of the query."""
    best = bm25(index, query, limit * OVERFETCH)
    counted, least = coverage_rule(query_tokens(query))
    covered = F.size(F.array_intersect("found", F.array(*map(F.lit, counted)).cast("array<int>")))
    return best.where(covered >= least).orderBy(F.desc(F.round("score", 9)), "id").limit(limit).select("id", "score")


def phrase(index: Index, query: str, limit: int = PHRASE_LIMIT) -> DataFrame:
    """Entries with all query tokens in a row (two at least), by id: the places of each token, shifted back
    by its place in the query, have one in common."""
    q = query_tokens(query)
    if len(q) < 2:
        return index.postings.where(F.lit(False)).select(F.col("entry_id").alias("id"))
    found = matches(index, q).where(F.col("token") == F.get(F.array(*map(F.lit, q)), F.col("q")))
    each = found.select("entry_id", "q", F.transform("positions", lambda p: p - F.col("q")).alias("at"))
    met = each.groupBy("entry_id").agg(F.count("*").alias("k"), F.collect_list("at").alias("ats")).where(F.col("k") == len(q))
    common = F.aggregate(F.slice("ats", 2, len(q)), F.get("ats", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return met.where(F.size(common) > 0).select(F.col("entry_id").alias("id")).orderBy("id").limit(limit)


def matched_entities(entities: DataFrame, text: str | None) -> DataFrame:
    """Entities whose name or an alias is one token of the text."""
    keys = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), fold)
    wanted = F.array(*map(F.lit, query_tokens(text))) if query_tokens(text) else F.array().cast("array<string>")
    return entities.where(F.arrays_overlap(keys, wanted))


def with_mentions(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Each entity with the number of links that spell its name exactly."""
    n = links.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("mentions"))
    return entities.join(n, "name", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def linked_entries(diary: Diary, entities: DataFrame, start: str | None = None, end: str | None = None, most: int = PER_ENTITY) -> DataFrame:
    """(name, id): each entity's newest entries in range, at most so many."""
    rows = diary.links.join(entities.select(F.col("name").alias("target")), "target").select("target", F.col("entry_id").alias("id")).distinct()
    rows = rows.join(diary.entries.where(in_range(F.col("date"), start, end)).select("id", "date", "ordinal"), "id")
    nth = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("date"), F.desc("ordinal"), "id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select(F.col("target").alias("name"), "id")


def related_entries(diary: Diary, entities: DataFrame | None, verb: str | None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries with a relation to one of the entities (or to anything), of the verb if one is given."""
    rows = diary.relations if verb is None else diary.relations.where(F.col("rel_type") == verb)
    if entities is not None:
        rows = rows.join(entities.select(F.col("name").alias("target")), "target", "left_semi")
    inside = diary.entries.where(in_range(F.col("date"), start, end)).select("id")
    return rows.select(F.col("entry_id").alias("id")).distinct().join(inside, "id")


def typed_entries(diary: Diary, kind: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries that link an entity of the type; names compare folded, types without case."""
    keys = diary.entities.where(F.lower("type") == kind.lower()).select(F.col("name_key").alias("target_key")).distinct()
    rows = diary.links.join(keys, "target_key", "left_semi").select(F.col("entry_id").alias("id")).distinct()
    return rows.join(diary.entries.where(in_range(F.col("date"), start, end)).select("id"), "id")


def hydrate(diary: Diary, hits: DataFrame) -> DataFrame:
    """The columns of hits (id and others), with each entry's date, time, ordinal, mood, intensity, body,
    snippet, links, tags, relations (verb -> targets) and superseded."""
    out = hits.join(diary.entries.select("id", "date", "time", "ordinal", "mood", "intensity", "body", snippet(F.col("body")).alias("snippet")), "id")
    key = hits.select(F.col("id").alias("entry_id"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])
    links = diary.links.join(key, "entry_id").groupBy("entry_id").agg(ordered("target").alias("links"))
    tags = diary.tags.join(key, "entry_id").groupBy("entry_id").agg(ordered("tag").alias("tags"))
    verbs = diary.relations.join(key, "entry_id").groupBy("entry_id", "rel_type").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    rel = verbs.groupBy("entry_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel_type", "targets")))).alias("relations"))
    old = diary.superseded.join(key, "entry_id").groupBy("entry_id").agg(F.max("newer_id").alias("superseded"))
    for t in (links, tags, rel, old):
        out = out.join(t.withColumnRenamed("entry_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"links": F.coalesce("links", none), "tags": F.coalesce("tags", none), "relations": F.coalesce("relations", F.create_map().cast("map<string,array<string>>"))})


def candidates(
    diary: Diary, index: Index, query: str | None = None, entity: str | None = None, relation: str | None = None, kind: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """(id, score) of every entry that some source brings, with its bonuses.

    Text hits score up to 1. A phrase adds to text hits only; entity and relation hits add or enter;
    typed entries enter with the entity bonus if no other source has them. Relation and type then
    filter what is left.
    """
    spark = diary.entries.sparkSession
    found = materialise(spark, matched_entities(diary.entities, entity if entity is not None else query), "found")
    near, names = diary, listed(found, "name")
    if names is not None:  # what points at few entities is taken where links and relations are read, once
        own = {t: materialise(spark, getattr(diary, t).where(F.col("target").isin(names)), t) for t in ("links", "relations")}
        near = replace(diary, **own)
    parts = []
    if query:
        hits = full_text(index, query)
        top = F.max("score").over(Window.partitionBy(F.lit(0)))  # twenty rows
        parts.append(hits.withColumn("top", top).select("id", F.lit("text").alias("source"), F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(1.0).alias("score")))
        parts.append(phrase(index, query).select("id", F.lit("phrase").alias("source"), F.lit(PHRASE_BONUS).alias("score")))
    parts.append(linked_entries(near, found, start, end).select("id").distinct().select("id", F.lit("entity").alias("source"), F.lit(ENTITY_BONUS).alias("score")))
    related = related_entries(near, found, relation, start, end)
    if relation:
        anyone = related_entries(diary, None, relation, start, end).join(F.broadcast(found.agg(F.count("*").alias("n"))).where("n = 0")).select("id")
        related = related.union(anyone).distinct()
    parts.append(related.select("id", F.lit("relation").alias("source"), F.lit(RELATION_BONUS).alias("score")))
    if kind:
        parts.append(typed_entries(diary, kind, start, end).select("id", F.lit("type").alias("source"), F.lit(ENTITY_BONUS).alias("score")))
    both = reduce(DataFrame.unionByName, parts).groupBy("id").agg(
        F.sum(F.when(F.col("source").isin("text", "entity", "relation"), F.col("score")).otherwise(0.0)).alias("own"),
        F.count_if(F.col("source").isin("text", "entity", "relation")).alias("members"),
        F.sum(F.when(F.col("source") == "phrase", F.col("score")).otherwise(0.0)).alias("phrase"),
        F.count_if(F.col("source") == "text").alias("texts"),
        F.max(F.when(F.col("source") == "type", F.col("score"))).alias("typed"),
    )
    score = F.when(F.col("members") > 0, F.col("own") + F.when(F.col("texts") > 0, F.col("phrase")).otherwise(0.0)).otherwise(F.col("typed"))
    out = both.select("id", score.alias("score")).where("score is not null")
    if relation:
        out = out.join(related, "id", "left_semi")
    if kind:
        out = out.join(typed_entries(diary, kind, start, end), "id", "left_semi")
    return out


def entity_context(diary: Diary, text: str | None) -> DataFrame:
    """What a query's entities are: name, type, aliases, and their mentions of all time."""
    return with_mentions(matched_entities(diary.entities, text), diary.links).select("name", "type", "aliases", F.col("mentions").alias("total_mentions_all_time"))


def recall(
    diary: Diary, index: Index, query: str | None = None, entity: str | None = None, relation: str | None = None, kind: str | None = None,
    start: str | None = None, end: str | None = None, limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """The best entries in range, with all that belongs to them: place (from 1), score (three decimals),
    total (the number before the limit), and the columns of hydrate.

    Ties go to entries not superseded, then to the newer; a query that asks for the present halves the
    weight of superseded entries in the order. The candidates (ids and scores) are written once, as they
    are both counted and ranked, with what supersedes them; only the best ones' rows are taken from the other tables.
    """
    spark = diary.entries.sparkSession
    found = materialise(spark, candidates(diary, index, query, entity, relation, kind, start, end), "candidates")
    rows = diary.entries.where(in_range(F.col("date"), start, end)).select("id", "date", "ordinal").join(found, "id")
    old = diary.superseded.join(found.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").groupBy(F.col("entry_id").alias("id")).agg(F.max("newer_id").alias("newer"), F.lit(True).alias("old"))
    rows = rows.join(old, "id", "left").withColumn("score", round_up(F.col("score"), 3))
    rows = materialise(spark, rows, "recall")
    weight = F.when(F.col("old"), SUPERSEDED_WEIGHT).otherwise(1.0) if asks_for_now(query) else F.lit(1.0)
    keys = [F.desc(F.col("score") * weight), F.col("old").isNotNull(), F.desc("date"), F.desc("ordinal"), F.col("id")]
    best = rows.orderBy(*keys).limit(limit if limit and limit > 0 else DEFAULT_LIMIT)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))  # of a few rows
    best = best.withColumn("place", place.cast("int")).join(rows.agg(F.count("*").alias("total"))).select("id", "place", "score", "total")
    best = materialise(spark, best, "best")
    diary = replace(diary, superseded=rows.where("old").select(F.col("id").alias("entry_id"), F.col("newer").alias("newer_id")))
    ids = listed(best, "id")
    if ids is not None:
        own = lambda t, key: getattr(diary, t).where(F.col(key).isin(ids))
        diary = replace(diary, entries=own("entries", "id"), links=own("links", "entry_id"), tags=own("tags", "entry_id"), relations=own("relations", "entry_id"))
    return hydrate(diary, best).orderBy("place")
