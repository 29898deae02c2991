"""Places, running sums and ranks over a whole table without bringing it into one task.

Rows are dealt over ranges of the order, so that each range is sorted by a task of its own; what comes before a range is one
number for each, which the driver adds up (as many rows as there are ranges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.staging import staged

#: monotonically_increasing_id has the number of the partition above these bits and the row's place in it below.
_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in the order, from 0. Rows that the order doesn't tell apart come in any order."""
    # staged, as the ranges have to stay what they were when they were counted
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    counts = ranged.groupBy(F.shiftright(name, _BITS).alias("_part")).agg(F.count("*").alias("_n"))
    placed = ranged.join(_before(counts, "_n"), F.shiftright(name, _BITS) == F.col("_part"))
    return placed.withColumn(name, F.col(name).bitwiseAND((1 << _BITS) - 1) + F.col("_before").cast("long")).drop("_part", "_before")


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each in the order."""
    ranged = staged(df.repartitionByRange(*order).withColumn("_at", F.shiftright(F.monotonically_increasing_id(), _BITS)))
    sums = ranged.groupBy(F.col("_at").alias("_part")).agg(F.sum(value).alias("_n"))
    within = F.sum(value).over(Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn(name, within).join(_before(sums, "_n"), F.col("_at") == F.col("_part"))
    return placed.withColumn(name, F.col(name) + F.col("_before").cast(ranged.select(F.sum(value).alias("s")).schema["s"].dataType)).drop("_at", "_part", "_before")


def _before(parts: DataFrame, value: str) -> DataFrame:
    """_part, _before: what the ranges before each one have; one row for each range."""
    rows, total = [], 0
    for r in parts.orderBy("_part").collect():
        rows.append((r["_part"], total))
        total += r[value] or 0
    kind = "double" if isinstance(total, float) else "long"
    return F.broadcast(parts.sparkSession.createDataFrame([(p, type(total)(b)) for p, b in rows], f"_part long, _before {kind}"))


def ranks(df: DataFrame, column: str, name: str, descending: bool = False) -> DataFrame:
    """``df`` with the rank of ``column``: one more than the rows before it; equal values share a rank, null ones too."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    ahead = running_sum(counts, [order], "_n", "_upto").select(F.col(column).alias("_of"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    return df.join(ahead, F.col(column).eqNullSafe(F.col("_of"))).drop("_of")
