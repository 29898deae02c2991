"""Closures, components, levels and lineage over edge tables. Every loop stages what it found, so a lost executor costs
one round, and stops when a round finds nothing new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.staging import dropped, staged


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and all that follows from them along src -> dst. Cycles end, as each node is taken once. A round
    writes the nodes that it found and no others."""
    front = staged(seeds.select("node").distinct())
    seen, links = front, edges.select("src", "dst")
    while True:
        fresh = links.join(front, links.src == front.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        front = staged(fresh.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that follow from ``start`` by ``step``, which gets the rows that the round before found. Each row is taken
    once, so the loop ends if there are finitely many."""
    front = staged(start.distinct())
    seen = front
    while True:
        fresh = step(front).select(*start.columns).distinct()
        old = seen.toDF(*[f"_{c}" for c in start.columns])
        match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in start.columns]
        front = staged(fresh.join(old, match, "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


#: Levels that are found one by one before chains are drawn together.
_SHALLOW = 12


def levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest way down to a node without outgoing edges. Nodes on or above a cycle have a null level.

    Nodes whose edges all lead to nodes with a level get theirs, a level a round. What is left after ``_SHALLOW`` rounds may be
    deep, and is drawn together: a node that points to one other node only has its level from that one, and such chains
    are led on to their ends by doubling, in the logarithm of the longest; the ends take the edges over, which may leave further
    nodes with one edge. What was drawn together gets its level last, in reverse order. ``least`` is the level that a node has at least by edges that are gone, ``far`` the length of a way."""
    left = staged(edges.select("src", "dst", F.lit(1).alias("far")).distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    least = staged(nodes.select("node", F.lit(0).alias("least")))
    done, chains, turn = None, [], 0
    while True:
        turn += 1
        # sinks have their level, and nodes that point to them know how high they are at least
        sinks = staged(least.join(left.select(F.col("src").alias("node")), "node", "left_anti").select("node", F.col("least").alias("level")))
        if sinks.isEmpty():
            break  # all that is left leads to cycles
        done = sinks if done is None else done.unionByName(sinks)
        hit = left.join(sinks.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("far") + F.col("level")).alias("by"))
        least = _replaced(least, least.join(sinks, "node", "left_anti").join(hit, "node", "left").select("node", F.greatest("least", "by").alias("least")))
        left = _replaced(left, left.join(sinks.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "far"))
        if turn <= _SHALLOW:
            continue
        single = left.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst"), F.first("far").alias("far")).filter("n = 1").select(F.col("src").alias("node"), "dst", "far")
        chain = _drawn_together(staged(single.join(least, "node")))
        if chain is not None:
            chains.append(chain)
            via = chain.select(F.col("node").alias("dst"), F.col("dst").alias("end"), F.col("far").alias("more"), F.col("least").alias("by"))
            rest = staged(left.join(chain.select(F.col("node").alias("src")), "src", "left_anti").join(via, "dst", "left"))
            hit = rest.groupBy(F.col("src").alias("node")).agg(F.max(F.col("far") + F.col("by")).alias("by"))
            least = _replaced(least, least.join(chain.select("node"), "node", "left_anti").join(hit, "node", "left").select("node", F.greatest("least", "by").alias("least")))
            left = _replaced(left, rest.groupBy("src", F.coalesce("end", "dst").alias("dst")).agg(F.max(F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
    for chain in reversed(chains):
        ends = done.select(F.col("node").alias("dst"), F.col("level").alias("at"))
        done = staged(done.unionByName(chain.join(ends, "dst").select("node", F.greatest(F.col("least"), F.col("far") + F.col("at")).alias("level"))))
    return nodes.join(done, "node", "left") if done is not None else nodes.withColumn("level", F.lit(None).cast("int"))


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` staged, and the files of ``old`` gone."""
    after = staged(new)
    dropped(old)
    return after


def _drawn_together(now: DataFrame) -> DataFrame | None:
    """node, dst, far, least of nodes with one edge, the edge led on to the end of its chain; None if there is none. Each
    round goes twice as far; what goes on after as many rounds as the longest chain could need leads to a cycle, and is left out."""
    n = now.count()
    for _ in range(n.bit_length() + 1):
        on = now.select(F.col("node").alias("dst"), F.col("dst").alias("next"), F.col("far").alias("more"), F.col("least").alias("by"))
        both = now.select("node", "dst", "far", "least").join(on, "dst", "left")
        after = staged(both.select("node", F.coalesce("next", "dst").alias("dst"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.greatest(F.col("least"), F.col("far") + F.col("by")).alias("least"), F.col("next").isNotNull().alias("went")))
        dropped(now)
        now = after
        if now.filter("went").isEmpty():
            break
    ended = staged(now.join(now.select(F.col("node").alias("dst")), "dst", "left_anti").select("node", "dst", "far", "least"))
    return None if ended.isEmpty() else ended


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): nodes that reach each other.

    By colours: every node takes the least node that reaches it, and those that in turn reach that node within its colour are
    its component. Nodes that nothing of the rest points to, or that point to nothing of it, are components of one; they are
    taken off first, so only what lies on cycles or between them is coloured. A round writes a row for each node at most."""
    left = staged(edges.filter("src <> dst").select("src", "dst").distinct())
    every = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    found = None
    while True:
        n = left.count()
        while n:  # trim
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            inner = inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            after = staged(inner)
            dropped(left)
            left, before, n = after, n, after.count()
            if n == before:
                break
        if not n:
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
        colours = staged(nodes.select("node", F.col("node").alias("colour")))
        while True:
            given = left.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            after = staged(colours.join(given, "node", "left").select("node", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("new")))
            dropped(colours)
            colours = after
            if colours.filter("new").isEmpty():
                break
            colours = staged(after.drop("new"))
            dropped(after)
        of = colours.select("node", "colour")
        same = left.join(of.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(of.select(F.col("node").alias("dst"), "colour"), "dst").filter("c = colour")
        inside = staged(same.select("src", "dst"))
        members = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), of.filter("node = colour").select("node"))
        part = staged(of.join(members, "node", "left_semi"))
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        after = staged(rest)
        dropped(left)
        left = after
    if found is None:
        return every.select("node", F.col("node").alias("component"))
    return every.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def best_below(rows: DataFrame, node: str, parent: str, value: Column) -> DataFrame:
    """node, best: the largest ``value`` among each node and all below it in a forest. Each round doubles how far below a
    node has looked: what it has goes to the node so far above it. Rows with a parent that isn't there are roots."""
    own = rows.select(F.col(node).alias("node"), F.col(parent).alias("up"), value.alias("best"))
    known = rows.select(F.col(node).alias("above"))
    state = staged(own.join(known, F.col("up") == F.col("above"), "left").select("node", F.col("above").alias("up"), "best"))
    while not state.filter("up IS NOT NULL").isEmpty():
        sent = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.max("best").alias("sent"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("further"))
        after = staged(state.join(sent, "node", "left").join(above, "up", "left").select("node", F.col("further").alias("up"), F.when(F.col("sent") > F.col("best"), F.col("sent")).otherwise(F.col("best")).alias("best")))
        dropped(state)
        state = after
    return state.select("node", "best")


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """grp, dominator, node: all pairs in which every way from the group's entry to the node passes the dominator; a node
    dominates itself. Nodes that the entry doesn't reach are in none.

    Edges (grp, src, dst) of many small graphs, such as one for each function, with an entry (grp, node) each. What is
    followed is the opposite: which nodes can be reached around which others; a graph has at most its nodes squared of them."""
    links = staged(edges.select("grp", "src", "dst").distinct())
    reached = fixpoint(entries.select("grp", "node"), lambda front: front.join(links, (front.grp == links.grp) & (front.node == links.src)).select(links.grp, F.col("dst").alias("node")))
    reached = staged(reached)
    first = entries.select("grp", F.col("node").alias("entry"))
    start = reached.withColumnRenamed("node", "around").join(first, "grp").filter("around <> entry").select("grp", "around", F.col("entry").alias("node"))

    def on(front: DataFrame) -> DataFrame:
        met = front.alias("f").join(links.alias("l"), (F.col("f.grp") == F.col("l.grp")) & (F.col("f.node") == F.col("l.src")) & (F.col("f.around") != F.col("l.dst")))
        return met.select("f.grp", "f.around", F.col("l.dst").alias("node"))

    around = fixpoint(start, on).withColumnRenamed("around", "dominator")
    every = reached.withColumnRenamed("node", "dominator").join(reached, "grp")
    return every.join(around, ["grp", "dominator", "node"], "left_anti").select("grp", "dominator", "node")


def immediate(pairs: DataFrame) -> DataFrame:
    """grp, node, n, idom: how many dominate a node, and of the others the nearest: the one that most dominate. Null for an entry."""
    n = pairs.groupBy("grp", "node").agg(F.count("*").alias("n"))
    depth = n.select("grp", F.col("node").alias("dominator"), F.col("n").alias("depth"))
    strict = pairs.filter("dominator <> node").join(depth, ["grp", "dominator"]).groupBy("grp", "node").agg(F.max_by("dominator", "depth").alias("idom"))
    return n.join(strict, ["grp", "node"], "left")


def natural_loops(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """grp, head, node: members of the loop of each head, a node that dominates another which points back to it."""
    back = edges.join(pairs.select("grp", F.col("dominator").alias("dst"), F.col("node").alias("src")), ["grp", "src", "dst"], "left_semi").select("grp", "src", "dst")
    links = staged(edges.select("grp", F.col("src").alias("before"), F.col("dst").alias("node")).distinct())
    start = back.select("grp", F.col("dst").alias("head"), F.explode(F.array("src", "dst")).alias("node"))
    known = pairs.select("grp", F.col("node").alias("before")).distinct()
    return fixpoint(start, lambda front: front.filter("node <> head").join(links, ["grp", "node"]).join(known, ["grp", "before"], "left_semi").select("grp", "head", F.col("before").alias("node")))


def live_in(edges: DataFrame, uses: DataFrame, kills: DataFrame) -> DataFrame:
    """grp, node, name: names that are live before each node: it uses them, or one that follows has them live and the node
    doesn't set them. ``uses`` and ``kills`` have grp, node, name."""
    links = staged(edges.select("grp", F.col("src").alias("before"), F.col("dst").alias("node")).distinct())
    kills = staged(kills.select("grp", F.col("node").alias("before"), "name").distinct())

    def back(front: DataFrame) -> DataFrame:
        met = front.join(links, ["grp", "node"]).select("grp", "before", "name")
        return met.join(kills, ["grp", "before", "name"], "left_anti").select("grp", F.col("before").alias("node"), "name")

    return fixpoint(uses.select("grp", "node", "name"), back)


def forest(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Each row with whether it is a root (no parent, or one that isn't there), how many children it has, and the node among
    its siblings that comes before it."""
    known = rows.select(F.col(node).alias("_p")).distinct()
    linked = rows.join(known, F.col(parent) == F.col("_p"), "left").withColumn("is_root", F.col("_p").isNull()).drop("_p")
    kids = rows.groupBy(F.col(parent).alias("_of")).agg(F.count("*").alias("n_children"))
    before = F.when(~F.col("is_root"), F.lag(node).over(Window.partitionBy(parent).orderBy(node)))
    return linked.withColumn("sibling", before).join(kids, F.col(node) == F.col("_of"), "left").drop("_of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def ready_and_blocked(edges: DataFrame, done: DataFrame) -> DataFrame:
    """node, pending, unblocks: how many of a caller's callees aren't done, and how many callers wait for a node."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct().join(done, "node", "left_anti")
    open_ = edges.join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
    pending = open_.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("pending"))
    waits = open_.join(done.select(F.col("node").alias("src")), "src", "left_anti").groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("unblocks"))
    out = nodes.join(pending, "node", "left").join(waits, "node", "left")
    return out.select("node", F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), F.coalesce("unblocks", F.lit(0)).cast("long").alias("unblocks"))


def wavefront(edges: DataFrame, draws: DataFrame, rounds: int) -> DataFrame:
    """node, wave: in which round a node is done. In each round the nodes whose callees are all done are tried; whether a
    node succeeds is fixed by its draw (node, success)."""
    nodes = staged(draws.select("node", "success"))
    done = staged(nodes.filter("false").select("node", F.lit(0).alias("wave")))
    for k in range(1, rounds + 1):
        waits = edges.join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node")).distinct()
        fresh = staged(nodes.filter("success").join(done, "node", "left_anti").join(waits, "node", "left_anti").select("node", F.lit(k).alias("wave")))
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
    return done


def grown_neighbourhood(edges: DataFrame, weights: DataFrame, seeds: int, size: int) -> DataFrame:
    """node, step: from the heaviest node, again and again the heaviest neighbour of what is taken. ``size`` is a few."""
    links = staged(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    order = [F.desc("weight"), F.asc("node")]
    taken = [r.node for r in weights.orderBy(*order).limit(seeds).collect()]
    while len(taken) < size:
        near = links.filter(F.col("src").isin(taken)).select(F.col("dst").alias("node")).distinct().filter(~F.col("node").isin(taken))
        best = near.join(weights, "node").orderBy(*order).limit(1).collect()
        if not best:
            break
        taken.append(best[0].node)
    return edges.sparkSession.createDataFrame(list(zip(taken, range(len(taken)))), "node long, step int")


def blocker_edges(steps: DataFrame, entity: str, order: str, classes: str) -> DataFrame:
    """cleared, revealed, n: for consecutive steps, each class that went with each that was never there before, which is where its
    entity has it first. Orders are distinct within an entity."""
    before = F.lag(classes).over(Window.partitionBy(entity).orderBy(order))
    gone = steps.withColumn("_before", before).select(entity, order, F.explode(F.array_except("_before", classes)).alias("cleared"))
    first = F.min(order).over(Window.partitionBy(entity, "revealed"))
    new = steps.select(entity, order, F.explode(F.array_distinct(classes)).alias("revealed")).withColumn("_first", first).filter(F.col("_first") == F.col(order))
    return gone.join(new.drop("_first"), [entity, order]).groupBy("cleared", "revealed").agg(F.count("*").alias("n"))
