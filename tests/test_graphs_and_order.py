"""Places, sums and ranks over whole tables, and graph operators, against slow versions on small random inputs."""

import random

from pyspark.sql import functions as F

from factloom.operators import graphs, intervals, order


def test_places_sums_and_ranks(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 1, 2, 3, 50]), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v int, w double").repartition(5)
    by = [F.asc_nulls_last("v"), F.desc("id")]
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    assert [(r.place, r.id) for r in order.numbered(df, by).orderBy("place").collect()] == [(k, r[0]) for k, r in enumerate(want)]
    sums = {r.id: r.s for r in order.running_sum(df, by, "w", "s").collect()}
    total = 0.0
    for r in want:
        total += r[2]
        assert abs(sums[r[0]] - total) < 1e-9
    ranks = {r.id: (r.up, r.down) for r in order.ranks(order.ranks(df, "v", "up"), "v", "down", descending=True).collect()}
    for i, v, _ in rows:
        last = lambda x: (x is None, x or 0)
        up = 1 + sum(last(o) < last(v) for _, o, _ in rows)
        down = 1 + sum(o is not None and (v is None or o > v) for _, o, _ in rows)
        assert ranks[i] == (up, down)
    none = df.filter("false")
    assert order.numbered(none, by).count() == order.running_sum(none, by, "w", "s").count() == order.ranks(none, "v", "r").count() == 0


def reach(edges, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in seen and b != without:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


def test_components_levels_and_forests(spark):
    rnd = random.Random(2)
    edges = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)})
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = {n for e in edges for n in e}
    to = {n: reach(edges, n) for n in nodes}
    want = {n: min(m for m in to[n] if n in to[m]) for n in nodes}
    assert len(set(want.values())) < len(nodes)
    assert {r.node: r.component for r in graphs.strong_components(df).collect()} == want
    cyclic = {n for n in nodes if any(n in to[b] for a, b in edges if a == n)}
    above = {n for n in nodes if to[n] & cyclic}
    longest = lambda n: 1 + max((longest(b) for a, b in edges if a == n), default=-1)
    assert {r.node: r.level for r in graphs.levels(df).collect()} == {n: None if n in above else longest(n) for n in nodes}
    tree = [(i, None if i % 17 == 0 else (99 if i == 5 else rnd.randrange(i)), rnd.randrange(1000)) for i in range(60)]
    best = {r.node: r.best for r in graphs.best_below(spark.createDataFrame(tree, "id long, up long, v long"), "id", "up", F.col("v")).collect()}
    below = lambda i: max([tree[i][2], *(below(k) for k, up, _ in tree if up == i)])
    assert best == {i: below(i) for i, _, _ in tree}


def test_dominators_loops_and_liveness(spark):
    rnd = random.Random(3)
    flows = {g: sorted({(k, k + 1) for k in range(8)} | {(rnd.randrange(9), rnd.randrange(9)) for _ in range(7)}) for g in range(6)}
    flows[6] = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (7, 8)]  # a diamond in a loop, and what the entry never reaches
    df = spark.createDataFrame([(g, a, b) for g, e in flows.items() for a, b in e], "grp long, src long, dst long")
    pairs = graphs.dominators(df, spark.createDataFrame([(g, 0) for g in flows], "grp long, node long"))
    got = {(r.grp, r.dominator, r.node) for r in pairs.collect()}
    want = set()
    for g, e in flows.items():
        for d in reach(e, 0):
            around = set() if d == 0 else reach(e, 0, without=d)
            want |= {(g, d, n) for n in reach(e, 0) if n not in around}
    assert got == want
    near = {(r.grp, r.node): r.idom for r in graphs.immediate(pairs).collect()}
    assert near[6, 3] == 0 and near[6, 0] is None
    loops = {}
    for r in graphs.natural_loops(df, pairs).collect():
        loops.setdefault((r.grp, r.head), set()).add(r.node)
    assert loops[6, 0] == {0, 1, 2, 3}
    uses = {(g, n, rnd.randrange(3)) for g in flows for n in range(9)}
    kills = {(g, n, rnd.randrange(3)) for g in flows for n in range(9)}
    live = set(uses)
    while True:
        more = {(g, a, v) for g, e in flows.items() for a, b in e for v in range(3) if (g, b, v) in live and (g, a, v) not in kills} - live
        if not more:
            break
        live |= more
    frame = lambda rows: spark.createDataFrame(sorted(rows), "grp long, node long, name long")
    assert {tuple(r) for r in graphs.live_in(df, frame(uses), frame(kills)).collect()} == live


def test_skipping_budget_keeps_nothing_between_keys(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice([None, 1.0, 2.5, 4.0, 9.0])) for k in ("a", None, "b") for i in range(40)]
    out = intervals.skipping_budget(spark.createDataFrame(rows, "k string, i int, c double"), ["k"], "i", "c", 20.0)
    want = set()
    for k in ("a", "b"):  # rows without a key join with none
        left = 20.0
        for _, i, c in [r for r in rows if r[0] == k]:
            if c is not None and c <= left:
                left -= c
                want.add((k, i))
    assert {(r.k, r.i) for r in out.collect()} == want
