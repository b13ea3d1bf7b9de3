"""Claiming names that no entity has: an anti-join, a keep-first claim within the batch, an append that can be repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold

STUBS = "name string, name_key string, type string, batch string"


def known_keys(entities: DataFrame) -> DataFrame:
    """(name_key): the folded names and aliases of entities, each once."""
    none = F.array().cast("array<string>")
    return entities.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", none))).alias("n")).select(fold(F.col("n")).alias("name_key")).distinct()


def new_names(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """(name, name_key) of mentions (target, place) whose folded target is not among known (name_key): of spellings
    that fold alike, the one of the least place, then the least itself. Null and blank targets are no names."""
    named = mentions.where(F.trim("target") != "").withColumn("name_key", fold(F.col("target")))
    first = named.groupBy("name_key").agg(F.min(F.struct("place", "target"))["target"].alias("name"))
    return first.join(known, "name_key", "left_anti").select("name", "name_key")


def least_places(mentions: DataFrame) -> DataFrame:
    """(target, place): each spelling once, with its least place; claims of these are those of all mentions."""
    return mentions.groupBy("target").agg(F.min("place").alias("place"))


def read_stubs(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STUBS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], STUBS)


def claim_names(spark: SparkSession, mentions: DataFrame, entities: DataFrame, path: str, batch: str) -> DataFrame:
    """Write a stub of unknown type for each new name of a batch to the table at path; returns the batch's stubs.

    Names that entities, their aliases or other batches have are not claimed again. A batch that is repeated under
    its name, as after a crash, overwrites what it wrote. One batch at a time.
    """
    others = read_stubs(spark, path).where(F.col("batch") != batch).select("name_key")
    fresh = new_names(mentions, known_keys(entities).union(others).distinct())
    fresh.select("name", "name_key", F.lit("unknown").alias("type")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return read_stubs(spark, path).where(F.col("batch") == batch)
