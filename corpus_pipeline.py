"""A training-corpus pipeline: five stages, each on all that the one before it kept.

Null text counts as empty in every stage. Rows are told apart by their own text, not by their id alone:
rows that share an id, or have none, stay or go each for itself, and of repeated rows one stays. All stages
but the last return the columns of documents, whatever their names. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.llm.common import new_path
from daybook.llm.decontaminate import drop_contaminated
from daybook.llm.exact_dedup import keep_first_copies
from daybook.llm.near_join import one_of_each_group
from daybook.llm.packing import pack
from daybook.llm.quality import keep_quality

ORACLE_SQL = None  # a trained classifier decides in the first stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; empty ones are scored like others."""
    return keep_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the least id. Empty texts are equal to each other."""
    return keep_first_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id. Texts without words all stay."""
    return one_of_each_group(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; those without an id are searched too."""
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_ids=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences: a row for each piece; an empty text has its end alone."""
    return pack(spark, docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
