"""The order in which open items of work are taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graphs, order
from factloom.sources.staging import staged


def projected(items: DataFrame, edges: DataFrame, visits_per_band: int = 2) -> DataFrame:
    """place (from 0), node, band, lane, depth, callers, in_unit, unit_rank of every open item, in the order of these columns
    (callers descending), then size, then node.

    ``items`` has node (each once), open, visits, lane (the earliest first), unit, address and size; ``edges`` has src, which
    needs dst first. ``band`` goes up every few visits, so that no lane starves what has had few. ``depth`` is the longest
    way through open items that come first; items that need each other share one, and others beyond them count.
    ``callers`` are the open items that wait directly. Of the rest, units with the fewest open items come first, then those
    of the least address of any of their items; an item without a unit comes after all that have one, a unit without
    addresses after those with. Null visits and sizes are zero, null lanes last. Edges from or to items that are not open or
    not there, of an item to itself, and repeated ones don't count. Only one row for each range of the order reaches the driver.
    """
    rows = staged(items.filter("open"))
    nodes = rows.select("node")
    known = edges.filter("src <> dst").select("src", "dst").distinct()
    known = staged(known.join(nodes, known.src == nodes.node, "left_semi").join(nodes, known.dst == nodes.node, "left_semi"))
    callers = known.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"))
    units = items.filter("unit is not null").groupBy("unit").agg(F.count_if("open").alias("in_unit"), F.min("address").alias("least")).filter("in_unit > 0")
    units = order.numbered(units, [F.asc_nulls_last("least"), F.asc("unit")], "unit_rank").drop("least")
    out = rows.join(_depths(known), "node", "left").join(callers, "node", "left").join(units, "unit", "left")
    out = out.select("node", F.floor(F.coalesce("visits", F.lit(0)) / visits_per_band).alias("band"), "lane", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("depth", "callers", "size")], "in_unit", "unit_rank")
    turn = [F.asc("band"), F.asc_nulls_last("lane"), F.asc("depth"), F.desc("callers"), F.asc_nulls_last("in_unit"), F.asc_nulls_last("unit_rank"), F.asc("size"), F.asc("node")]
    return order.numbered(out, turn).drop("size")


def _depths(edges: DataFrame) -> DataFrame:
    """node, depth of the nodes of ``edges``, cycles drawn together."""
    of = staged(graphs.strong_components(edges).select("node", "component"))
    src, dst = (of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("src", "dst"))
    between = edges.join(src, "src", "left").join(dst, "dst", "left").select(F.coalesce("of_src", "src").alias("src"), F.coalesce("of_dst", "dst").alias("dst"))
    level = graphs.levels(staged(between.filter("src <> dst").distinct()))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(of, "node", "left")
    nodes = nodes.select("node", F.coalesce("component", "node").alias("component"))
    return nodes.join(level.select(F.col("node").alias("component"), F.col("level").alias("depth")), "component", "left").select("node", "depth")
