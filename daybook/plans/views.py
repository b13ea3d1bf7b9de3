"""The derived tables bound to star-schema and text tables, in Spark and as SQL for a second engine.

Orders are entries; their parts and their customer's nation are links, return flags with suppliers
relations, part types and the nation tags; parts, suppliers and customers are entities; events give the
daily measurements. All rows of all tables take part. Each SQL view computes the same rows as its DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators.search import build_index
from ..operators.tables import Diary, Index
from ..sources.storage import new_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("journal/"), day, F.lit(".md")).alias("file"), day.alias("date"), F.lit("08:00").alias("time"),
        (F.col("o_orderkey") % 7).cast("int").alias("ordinal"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("mood"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("intensity"), F.concat_ws("\n", "o_orderpriority", F.lit(""), "o_orderstatus").alias("body"),
    )


def _with_key(df: DataFrame, *names: str) -> DataFrame:
    """df with each name's folded key (name_key), for tables of few names that many rows are joined with."""
    return df.withColumns({f"{n}_key": fold(F.col(n)) for n in names})


def _keyed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_key", fold(F.col(column)))


def diary(spark: SparkSession, sf_dir: str) -> Diary:
    orders, lines, parts, suppliers, customers, nations = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "supplier", "customer", "nation"))
    own = F.col("l_orderkey").cast("string").alias("entry_id")
    kind = parts.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", F.lower("p_type").alias("p_small"))
    sold = lines.join(_with_key(kind, "p_name", "p_type", "p_small"), "l_partkey")
    nations = _with_key(nations, "n_name")
    where = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    home = where.join(lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("entry_id"), "n_name", F.lit(0).alias("pos"), "n_name_key")
    first = F.min("l_linenumber").cast("int").alias("pos")
    named_home = lambda n: home.toDF("entry_id", n, "pos", f"{n}_key")
    each = lambda n, c, k: sold.groupBy(own, c.alias(n), k.alias(f"{n}_key")).agg(first).select("entry_id", n, "pos", f"{n}_key").unionByName(named_home(n))
    links = each("target", F.col("p_name"), F.col("p_name_key"))
    even = F.col("l_linenumber") % 2 == 0
    tags = each("tag", F.when(even, F.col("p_small")).otherwise(F.col("p_type")), F.when(even, F.col("p_small_key")).otherwise(F.col("p_type_key")))
    verb = F.when(F.col("l_returnflag") == "A", "joy").when(F.col("l_returnflag") == "R", "trigger").otherwise("with")
    by = lines.join(_with_key(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.upper("s_name").alias("s_large")), "s_name", "s_large"), "l_suppkey")
    named = lambda end: F.when(even, F.col(f"s_large{end}")).otherwise(F.col(f"s_name{end}"))
    relations = by.select(own, verb.alias("rel_type"), named("").alias("target"), named("_key").alias("target_key")).distinct()
    none = F.array().cast("array<string>").alias("aliases")
    kinds = parts.groupBy(F.col("p_name").alias("name")).agg(F.lower(F.min_by("p_type", "p_partkey")).alias("type")).select("name", "type", none)
    people = suppliers.select(F.col("s_name").alias("name"), F.lit("unknown").alias("type"), F.array(F.concat(F.lit("s"), "s_suppkey")).alias("aliases"))
    buyers = customers.select(F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("type"), none)
    entities = kinds.unionByName(people).unionByName(buyers).select("name", fold(F.col("name")).alias("name_key"), F.concat(F.lit("entities/"), "name", F.lit(".md")).alias("file"), "type", "aliases")
    events = read(spark, sf_dir, "events").withColumn("date", F.date_format(F.col("ts") - F.expr("interval 1000 days"), "yyyy-MM-dd"))
    daily = events.groupBy("date").agg(F.round(F.avg("value"), 6).alias("sleep_hours"), F.when(F.count_if(F.col("event_type") == "click") > 60, "run").alias("exercise"), F.count("*").cast("double").alias("mood_score"))
    daily = daily.select(F.concat(F.lit("journal/"), "date", F.lit(".md")).alias("file"), "*", F.create_map().cast("map<string,string>").alias("extra"))
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    old = orders.withColumn("later", later).where("o_orderstatus = 'P' and later is not null").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.col("later").cast("string").alias("newer_id"))
    return Diary(entries(spark, sf_dir), links, relations, tags, entities, daily, old)


def diary_of_parts(spark: SparkSession, sf_dir: str) -> Diary:
    """The same orders, linking each of their parts by number, and their customer. Parts and customers keep
    the number of their orders at every scale, so shared links stay selective."""
    whole = diary(spark, sf_dir)
    orders, lines, parts, customers = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "customer"))
    name = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))
    sold = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), name.alias("target")), "l_partkey")
    links = sold.groupBy(F.col("l_orderkey").cast("string").alias("entry_id"), "target").agg(F.min("l_linenumber").cast("int").alias("pos"))
    buyer = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("entry_id"), F.col("c_name").alias("target"), F.lit(0).alias("pos"))
    entities = parts.select(name.alias("name"), F.lower("p_type").alias("type")).withColumns({"name_key": fold(F.col("name")), "file": F.lit(""), "aliases": F.array().cast("array<string>")})
    return Diary(whole.entries, _keyed(links.unionByName(buyer), "target"), whole.relations, whole.tags, entities, whole.daily_meta, whole.superseded)


#: Fields and text of a line's section, by its number's remainder by four; {} is the line.
NOTE_KINDS = ["mood:: calm/3\n{}", "tags:: red, blue\nwith:: [[Ann]], [[Bob|B]]\n{}", "superseded:: 2024-01-02#3\n{} [[Ann|her]] #green", "{}"]


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scanned files of a vault: journals whose lines are sections, with frontmatter; every seventh is
    an entity."""
    docs = corpus(spark, sf_dir).withColumn("n", F.col("id").cast("long"))
    kinds = F.array(*map(F.lit, NOTE_KINDS))
    section = lambda x, i: F.concat(F.lit("## "), F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":30\n"), F.substring_index(F.get(kinds, i % 4), "{}", 1), x, F.substring_index(F.get(kinds, i % 4), "{}", -1))
    journal = F.concat(F.lit("---\nsleep_hours: "), F.col("n") % 9, F.lit("\nexercise: run\nother: x\n---\n"), F.array_join(F.transform(F.split("body", "\n", -1), section), "\n\n"))
    entity = F.concat(F.lit("---\ntype: thing\naliases: [a"), "id", F.lit(", b]\n---\n# Facts\n"), "body")
    is_entity = F.col("n") % 7 == 0
    path = F.concat(F.when(is_entity, "entities/").otherwise("journal/"), F.lit("d"), "id", F.lit(".md"))
    return docs.select(path.alias("path"), F.col("n").alias("mtime"), F.when(is_entity, "entity").otherwise("journal").alias("kind"), F.when(is_entity, entity).otherwise(journal).cast("binary").alias("content"))


#: Sections of note_files in SQL.
SQL_NOTES = """
lines AS (SELECT 'd' || id AS name, n, i, l[i + 1] AS line FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS n, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id % 7 <> 0), unnest(range(len(l))) r(i)),
notes AS (SELECT name || '#' || i AS id, name, n, CAST(i AS INTEGER) AS ordinal, lpad(CAST(i % 24 AS VARCHAR), 2, '0') || ':30' AS time, CASE WHEN i % 4 = 0 THEN 'calm' END AS mood, CASE WHEN i % 4 = 0 THEN 3 END AS intensity,
    CASE WHEN i % 4 = 2 THEN line || ' [[Ann|her]] #green' WHEN trim(line) = '' THEN '' ELSE line END AS body, CASE WHEN i % 4 = 2 THEN 'Ann' END AS links,
    CASE i % 4 WHEN 1 THEN 'red,blue' WHEN 2 THEN 'green' END AS tags, CASE WHEN i % 4 = 1 THEN 'with=Ann,Bob' END AS relations FROM lines)
"""


SQL_VIEWS = """
entries AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'journal/' || strftime(o_orderdate, '%Y-%m-%d') || '.md' AS file, strftime(o_orderdate, '%Y-%m-%d') AS date, '08:00' AS time,
    CAST(o_orderkey % 7 AS INTEGER) AS ordinal, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS mood, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS intensity,
    o_orderpriority || chr(10) || chr(10) || o_orderstatus AS body FROM orders),
home AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS entry_id, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
links AS (SELECT CAST(l_orderkey AS VARCHAR) AS entry_id, p_name AS target, CAST(min(l_linenumber) AS INTEGER) AS pos, lower(p_name) AS target_key FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_name
    UNION ALL SELECT entry_id, n_name, 0, lower(n_name) FROM home),
tags AS (SELECT CAST(l_orderkey AS VARCHAR) AS entry_id, CASE WHEN l_linenumber % 2 = 0 THEN lower(p_type) ELSE p_type END AS tag, CAST(min(l_linenumber) AS INTEGER) AS pos, lower(p_type) AS tag_key FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
    UNION ALL SELECT entry_id, n_name, 0, lower(n_name) FROM home),
relations AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS entry_id, CASE l_returnflag WHEN 'A' THEN 'joy' WHEN 'R' THEN 'trigger' ELSE 'with' END AS rel_type,
    CASE WHEN l_linenumber % 2 = 0 THEN upper(s_name) ELSE s_name END AS target, lower(s_name) AS target_key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
entities AS (SELECT p_name AS name, lower(arg_min(p_type, p_partkey)) AS type, NULL AS alias FROM part GROUP BY p_name
    UNION ALL SELECT s_name, 'unknown', 's' || CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT c_name, lower(c_mktsegment), NULL FROM customer),
daily AS (SELECT date, round(avg(value), 6) AS sleep_hours, CASE WHEN count(*) FILTER (WHERE event_type = 'click') > 60 THEN 'run' END AS exercise, CAST(count(*) AS DOUBLE) AS mood_score
    FROM (SELECT *, strftime(ts - INTERVAL 1000 DAY, '%Y-%m-%d') AS date FROM events) GROUP BY date),
old AS (SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, CAST(later AS VARCHAR) AS newer_id FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders)
    WHERE o_orderstatus = 'P' AND later IS NOT NULL)
"""

#: The links and entities of diary_of_parts in SQL.
SQL_PARTS = """
plinks AS (SELECT CAST(l_orderkey AS VARCHAR) AS entry_id, 'Part ' || CAST(l_partkey AS VARCHAR) AS target, CAST(min(l_linenumber) AS INTEGER) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), c_name, 0 FROM orders JOIN customer ON o_custkey = c_custkey),
pentities AS (SELECT 'Part ' || CAST(p_partkey AS VARCHAR) AS name, lower(p_type) AS type FROM part)
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("body"))


_INDEXES: dict[tuple, Index] = {}


def index_of(spark: SparkSession, sf_dir: str, what: str = "documents") -> Index:
    """The stored index over documents (or the orders' entries), written once in a session for each table."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _INDEXES:
        rows = corpus(spark, sf_dir) if what == "documents" else entries(spark, sf_dir)
        _INDEXES[key] = build_index(spark, rows, new_path(spark, "index"))
    return _INDEXES[key]


#: Folded tokens of documents in SQL.
SQL_TOKENS = """
docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(lower(replace(replace(strip_accents(coalesce(text, '')), 'đ', 'd'), 'Đ', 'D')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents)
"""
SQL_ENTRY_TOKENS = "docs AS (SELECT id, list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM entries)"
