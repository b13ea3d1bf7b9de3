"""Check-in fields as typed values: JSON texts of a day are merged by key, the latest value of each counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_fields(rows: DataFrame, group: str, order: str, fields: str) -> DataFrame:
    """(group, key, value) of rows whose fields are JSON texts: of each key of a group the value that comes last by
    order, then by its text. value is a VARIANT, so numbers, texts and nested values keep their types.

    Texts that are null, malformed or no object are ignored; a key set to null counts as set. Groups merge by
    partial aggregates: a row is one value for each key, never a group's list.
    """
    parsed = rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.try_parse_json(fields).alias("_fields")).where(F.schema_of_variant("_fields").startswith("OBJECT"))
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_fields").outer())).select("_group", "_order", "key", F.to_json("value").alias("_text"))
    last = each.groupBy("_group", "key").agg(F.max(F.struct("_order", "_text"))["_text"].alias("_text"))
    return last.select(F.col("_group").alias(group), "key", F.parse_json("_text").alias("value"))


def as_objects(merged: DataFrame, group: str) -> DataFrame:
    """(group, fields): the merged fields of each group as one VARIANT object."""
    member = F.to_json(F.create_map(F.col("key"), F.lit(0)))
    name = F.substring(member, 2, F.length(member) - 3)  # {"key":0} -> "key":, escaped as JSON has it
    pairs = F.array_sort(F.collect_list(F.concat(name, F.to_json("value"))))
    return merged.groupBy(group).agg(F.parse_json(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).alias("fields"))
