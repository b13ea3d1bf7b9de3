"""Running sums within groups of any size: a sort over ranges, so that no task gets a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows of the group before and at each row, in the given order.

    Rows are sorted over ranges of group and order and written once; each part's sum by group is a row, and
    these few are summed up to the parts ahead. Equal keys lie in one part, and are summed as they come.
    """
    sorted_ = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    sorted_ = materialise(rows.sparkSession, sorted_, "sorted")
    within = F.sum(value).over(Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    parts = sorted_.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return sorted_.withColumn(name, within).join(parts, [*group, "_part"]).withColumn(name, F.col(name) + F.col("_ahead")).drop("_part", "_at", "_ahead")
