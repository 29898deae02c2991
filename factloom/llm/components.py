"""Connected components of an edge table by alternating stars, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of ``edges`` (a, b: long) the least node that it is linked with.

    A large star ties a node's larger neighbours to the least neighbour, a small star its smaller ones. The two are
    repeated until nothing changes; the number of rounds grows with the logarithm of the longest chain. A node with
    many neighbours is an ordinary skewed join key, which adaptive execution splits.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # each larger neighbour of a node gets the node's least neighbour
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        unstage(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            # a star's centre is its own root
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
