"""Row numbers and running sums over a whole table without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import stage


def range_sorted(df: DataFrame, order: list[str], partitions: int, name: str) -> DataFrame:
    """``df`` staged in range partitions of ``order``, sorted within each, with the partition's number as ``_part``
    and the row's place in it as ``_row``."""
    placed = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # the identifier is the partition in its upper bits and the row's place in its lower 33
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    return stage(placed.drop("_id"), name)


def partition_offsets(df: DataFrame, keys: list[str], measure: Column) -> DataFrame:
    """For each range partition and key, the sum of ``measure`` over the same key in the partitions before it.

    One row for each pair of partition and key that occur together, at most the number of partitions plus the
    number of keys where the table is sorted by the keys; so it is small enough for one window for each key.
    """
    from pyspark.sql import Window

    sums = df.groupBy("_part", *keys).agg(measure.alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
