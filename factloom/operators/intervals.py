"""Runs, clusters, overlaps and gaps of ordered positions and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.order import numbered
from factloom.sources.staging import staged


def stride_runs(df: DataFrame, keys: list[str], position: str, stride: int, least: int) -> DataFrame:
    """Rows that lie in a run of at least ``least`` distinct positions ``stride`` apart. Repeated positions share a run;
    rows with a null position are in none."""
    places = df.filter(F.col(position).isNotNull()).select(*keys, position).distinct()
    by = Window.partitionBy(*keys).orderBy(position)
    island = F.col(position) - F.lit(stride) * F.row_number().over(by)
    # positions that differ by the stride keep the same island; the remainder tells interleaved runs apart
    marked = places.withColumn("_island", island)
    size = F.count("*").over(Window.partitionBy(*keys, "_island"))
    runs = marked.withColumn("_n", size).filter(F.col("_n") >= least).select(*keys, position)
    return df.join(runs, [*keys, position], "left_semi")


def gap_clusters(df: DataFrame, keys: list[str], position: str, gap: int, name: str = "cluster") -> DataFrame:
    """``df`` with the number of its cluster: a new one starts where the position is more than ``gap`` behind the last."""
    by = Window.partitionBy(*keys).orderBy(position)
    starts = F.when(F.col(position) - F.lag(position).over(by) > gap, 1).otherwise(0)
    running = by.rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_start", starts).withColumn(name, F.sum("_start").over(running).cast("long")).drop("_start")


def interval_clusters(df: DataFrame, keys: list[str], start: str, end: str, gap: int, tie: str, name: str = "cluster") -> DataFrame:
    """As :func:`gap_clusters` for intervals, measured from the largest end so far, so nested intervals make no gap. An
    interval without an end is a barrier: what follows starts anew."""
    by = Window.partitionBy(*keys).orderBy(start, tie)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    far, barrier = F.max(end).over(before), F.lag(F.col(end).isNull()).over(by)
    starts = F.when(F.coalesce(barrier, F.lit(False)) | (F.col(start) - far > gap), 1).otherwise(0)
    return df.withColumn("_start", starts).withColumn(name, F.sum("_start").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_start")


def overlaps_next(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Intervals that reach past the start of the next one, with that start as ``next_start``."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, tie))
    return df.withColumn("next_start", following).filter(F.col("next_start") < F.col(end))


def uncovered(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Gaps between what the intervals cover: keys, gap_start, gap_end."""
    by = Window.partitionBy(*keys).orderBy(start, tie)
    far = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("gap_start", far).filter(F.col("gap_start") < F.col(start)).select(*keys, "gap_start", F.col(start).alias("gap_end"))


def contained_in(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, bucket: int) -> DataFrame:
    """Points joined with the spans that hold them, both ends included. Spans are dealt over the buckets they touch, so
    it is an equality join with a residual; a point meets each span once, in its own bucket."""
    wide = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    near = points.withColumn("_b", F.floor(F.col(point) / bucket))
    return near.join(wide, "_b").filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """``left`` with the right side's latest ``value`` at or before ``at`` for equal keys, null if there is none. One
    window over both sides; of right rows at the same time the largest value counts."""
    r = right.groupBy(*keys, at).agg(F.max(value).alias("_value"))
    both = left.withColumn("_value", F.lit(None).cast(r.schema["_value"].dataType)).withColumn("_left", F.lit(1)).unionByName(r.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    seen = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, seen).filter("_left = 1").drop("_left", "_value")


def running_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows kept while their running cost stays within the budget; it stops at the first that doesn't fit."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_spent", F.sum(cost).over(by)).filter(F.col("_spent") <= budget).drop("_spent")


def skipping_budget(df: DataFrame, keys: list[str], order: str, cost: str, budget: float) -> DataFrame:
    """Rows kept while the cost of what is kept stays within the budget; one that doesn't fit is skipped, and so is one
    without a cost. The decision depends on those before, so it is a fold over each key's rows in order; a task reads them
    as they come and holds one number."""
    narrow = df.select(*keys, order, F.col(cost).cast("double").alias("_cost"))
    at = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), 0.0
        for batch in batches:
            kept = []
            for key, c in zip(zip(*(batch.column(i).to_pylist() for i in range(at))), batch.column(at + 1).to_pylist()):
                if key != now:
                    now, left = key, budget
                fits = c is not None and c <= left
                if fits:
                    left -= c
                kept.append(fits)
            yield batch.filter(pa.array(kept, pa.bool_()))

    kept = narrow.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(fold, narrow.schema)
    return df.join(kept.select(*keys, order), [*keys, order], "left_semi")


#: Blocks of consecutive places that the driver knows sums of, at most, and those that a round looks into at once.
_BLOCKS, _AT_ONCE = 4096, 64


def skipping_budget_of_all(df: DataFrame, order: list[Column], cost: str, budget: int, block_rows: int | None = None) -> DataFrame:
    """:func:`skipping_budget` over a whole table as one order, with whole costs; rows with a null or negative cost are skipped.

    While 2^k or more is left, every cost below 2^k fits; a cost below 2^(k+1) fits once at most, and then less than 2^k is left. So
    the fold is a running sum until one of two events: the small costs have used up the budget down to 2^k, or a
    large cost fits. Blocks of places have the sum of their costs and the least cost for each power of two, a tree of one level whose rows
    the driver holds; it passes over blocks without an event and has the others looked into. There are two events a power at most."""
    placed = numbered(df.withColumn("_cost", F.col(cost).cast("long")), order, "_at")
    # the power of two of a cost by its binary digits; -1 for nothing
    placed = staged(placed.withColumn("_k", F.when(F.col("_cost") > 0, F.length(F.bin("_cost")) - 1).otherwise(-1)))
    usable = placed.filter("_cost >= 0")
    n = placed.agg(F.max("_at")).first()[0]
    if n is None:
        return df.limit(0)
    width = block_rows or max(1 << 12, -(-(n + 1) // _BLOCKS))
    block = F.floor(F.col("_at") / width).cast("int")
    summary: dict[int, dict[int, tuple[int, int]]] = {}
    for r in usable.groupBy(block.alias("b"), "_k").agg(F.sum("_cost").alias("s"), F.min("_cost").alias("m")).collect():  # 64 rows a block at most
        summary.setdefault(r.b, {})[r["_k"]] = (r.s, r.m)
    blocks = sorted(summary)
    left, at, kept = int(budget), 0, []  # what is left before place ``at``
    while left >= 0 and at <= n:
        k = left.bit_length() - 1  # 2^k <= left; only costs of nothing fit where nothing is left
        small = lambda b: sum(s for q, (s, _) in summary[b].items() if q < k)
        # blocks that may have an event if none before has one, and what is left before each
        look, ahead, partly = [], left, at % width != 0
        for b in blocks:
            if b < at // width or (b == at // width and partly):
                continue
            after = ahead - small(b)
            large = summary[b].get(k)
            if (k >= 0 and after < 1 << k) or (large and large[1] <= ahead):
                look.append((b, ahead))
            if (k >= 0 and after < 1 << k) or (large and large[1] <= after) or len(look) == _AT_ONCE:
                break
            ahead = after
        if partly:  # the rest of a block that has had an event; what it leaves is known when it has been looked into
            look = [(at // width, left)]
        event = _first_event(usable.filter(F.col("_at") >= at), look, width, k) if look else None
        to = event["at"] if event else (look[-1][0] + 1) * width if look else n + 1
        if event:
            kept.append((at, event["at"], k, event["at"] if event["large"] else None))
            left, at = event["left"], event["at"] + 1
        else:
            kept.append((at, to - 1, k, None))
            if partly:
                left -= usable.filter((F.col("_at") >= at) & (F.col("_at") < to) & (F.col("_k") < k)).agg(F.coalesce(F.sum("_cost"), F.lit(0))).first()[0]
            else:
                left -= sum(small(b) for b in blocks if at // width <= b < to // width) if to <= n else 0
            at = to
    # places from, to, power below which all is kept, and a large one: as many as there were rounds
    rule = F.lit(False)
    for a, to, k, large in kept:
        rule |= F.col("_at").between(a, to) & (F.col("_k") < k if k >= 0 else F.col("_k") < 0)
        if large is not None:
            rule |= F.col("_at") == large
    return usable.filter(rule).drop("_at", "_cost", "_k")


def _first_event(rows: DataFrame, look: list[tuple[int, int]], width: int, k: int) -> dict | None:
    """The first place in the blocks of ``look`` (block, what is left before it) where less than 2^k is left or a cost of 2^k or more fits."""
    before = rows.sparkSession.createDataFrame(look, "_b int, _before long")
    inside = rows.filter((F.col("_at") >= look[0][0] * width) & (F.col("_at") < (look[-1][0] + 1) * width)).withColumn("_b", F.floor(F.col("_at") / width).cast("int")).join(F.broadcast(before), "_b")
    upto = Window.partitionBy("_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_left", F.col("_before") - F.sum(F.when(F.col("_k") < k, F.col("_cost")).otherwise(0)).over(upto))
    large = (F.col("_k") == k) & (F.col("_cost") <= F.col("_left")) & F.lit(k >= 0)
    down = (F.col("_k") < k) & (F.col("_left") < F.lit(1 << max(k, 0)))
    after = F.when(large, F.col("_left") - F.col("_cost")).otherwise(F.col("_left"))
    r = inside.filter(large | down).agg(F.min(F.struct(F.col("_at").alias("at"), after.alias("left"), large.alias("large")))).first()[0]
    return r.asDict() if r else None
