"""Merging entities over tables: redirects resolved to their end, links rewritten outside code, aliases united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..sources.storage import materialise

# The formats of fenced code and links.
FENCE = r"(?s)```.*?```|~~~.*?~~~"
LINK = r"\[\[([^\[\]]+?)\]\]"


def resolve(spark: SparkSession, redirects: DataFrame) -> DataFrame:
    """(source, target, cyclic) for redirects (source, into): where each source ends up.

    A source that is redirected to several counts with the least of them; one that is redirected to itself is
    left out. Each round joins every open pointer to the one it points at, so that chains of n settle in
    log2(n) rounds; pointers at their end are not joined again. What is still open then leads into a cycle: it
    is cyclic, and its target is null.
    """
    first = redirects.where("source is not null and into is not null").groupBy("source").agg(F.min("into").alias("at")).where("source <> at")
    open_ = materialise(spark, first.join(first.select(F.col("source").alias("at"), F.lit(True).alias("more")), "at", "left").select("source", "at", F.coalesce("more", F.lit(False)).alias("more")), "redirects")
    done = [open_.where("not more").select("source", F.col("at").alias("target"), F.lit(False).alias("cyclic"))]
    left = open_.where("more")
    jumps = open_.select(F.col("source").alias("at"), F.col("at").alias("next"), F.col("more").alias("on"))
    rounds = max(1, open_.count()).bit_length() + 1
    for _ in range(rounds):
        if not left.limit(1).count():
            break
        # What a pointer points at has jumped as far as it, so each round doubles the way.
        now = materialise(spark, left.select("source", "at").join(jumps, "at").select("source", F.col("next").alias("at"), F.col("on").alias("more")), "redirects")
        done.append(now.where("not more").select("source", F.col("at").alias("target"), F.lit(False).alias("cyclic")))
        left = now.where("more")
        settled = jumps.where("not on").unionByName(now.where("not more").select(F.col("source").alias("at"), F.col("at").alias("next"), F.col("more").alias("on")))
        jumps = materialise(spark, settled.unionByName(left.select(F.col("source").alias("at"), F.col("at").alias("next"), F.col("more").alias("on"))), "jumps")
    out = left.select("source", F.lit(None).cast("string").alias("target"), F.lit(True).alias("cyclic"))
    for part in done:
        out = out.unionByName(part)
    return out


def rewrite_links(body: Column, names: Column) -> Column:
    """body with the targets of its links replaced by what the map names has for them, shown as before; fenced
    code stays."""
    none = F.array().cast("array<string>")

    def woven(text: Column, pattern: str, group: int, plain, special) -> Column:
        """text with plain over what lies between matches, and special over the matches."""
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        last = F.transform(F.array(F.get(between, F.size(between) - 1)), plain)
        pairs = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("f")), lambda z: F.concat(plain(z["b"]), special(z["f"])))
        return F.array_join(F.concat(F.coalesce(pairs, none), last), "")

    def link(inner: Column) -> Column:
        target = F.substring_index(inner, "|", 1)
        other = F.try_element_at(names, trim(target))
        return F.concat(F.lit("[["), F.when(other.isNotNull(), F.concat(other, F.substring(inner, F.length(target) + 1, F.length(inner)))).otherwise(inner), F.lit("]]"))

    prose = lambda t: woven(t, LINK, 1, lambda x: x, link)
    return F.when(body.isNotNull(), woven(body, FENCE, 0, prose, lambda x: x))


def merged_aliases(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """entities (name, aliases, others) without those merged away; an entity that others were merged into has
    its own aliases, then for each of them by name its aliases and its name, each once and without its own."""
    none = F.array().cast("array<string>")
    moves = resolved.where("not cyclic").join(entities.select(F.col("name").alias("source"), F.coalesce("aliases", none).alias("theirs")), "source", "left")
    given = moves.groupBy(F.col("target").alias("name")).agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("theirs", none).alias("theirs")))).alias("_given"))
    added = F.flatten(F.transform("_given", lambda g: F.concat(g["theirs"], F.array(g["source"]))))
    kept = entities.join(resolved.where("not cyclic").select(F.col("source").alias("name")), "name", "left_anti").join(given, "name", "left")
    united = F.when(F.col("_given").isNotNull(), F.array_remove(F.array_distinct(F.concat(F.coalesce("aliases", none), added)), F.col("name"))).otherwise(F.col("aliases"))
    return kept.withColumn("aliases", united).drop("_given").select(*entities.columns)


def redirect_column(rows: DataFrame, resolved: DataFrame, column: str) -> DataFrame:
    """rows with what the column names replaced by where it was merged into."""
    ends = resolved.where("not cyclic").select(F.col("source").alias(column), F.col("target").alias("_target"))
    return rows.join(ends, column, "left").withColumn(column, F.coalesce("_target", column)).drop("_target").select(*rows.columns)


def rewritten_bodies(entries: DataFrame, links: DataFrame, resolved: DataFrame) -> DataFrame:
    """The entries (id, body) whose links (entry_id, target) name a merged entity, with their bodies rewritten."""
    ends = resolved.where("not cyclic").select(F.col("source").alias("target"), F.col("target").alias("_to"))
    names = links.select("entry_id", "target").distinct().join(ends, "target").groupBy(F.col("entry_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("target", "_to"))).alias("_names"))
    return entries.join(names, "id").withColumn("body", rewrite_links(F.col("body"), F.col("_names"))).drop("_names").select(*entries.columns)
