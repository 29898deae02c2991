import math
import random

import pytest

from factloom.operators import graphs, statistics


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.7, 1.0])
def test_places_of_large_and_tied_groups(spark, fraction):
    rnd = random.Random(1)
    groups = {
        "wide": [rnd.choice([1, -1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(3000)],
        "ties": [float(rnd.randint(0, 3)) for _ in range(3000)],
        "one": [5.0],
        "same": [2.5] * 500,
        "odd ones": [float("nan"), float("inf"), -math.inf, 0.0, 1.0] * 40,
        "normal": [rnd.gauss(0, 1) for _ in range(5001)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("empty", None), (None, 3.0), (None, 1.0)]
    got = {r.g: r.x for r in statistics.order_statistic(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", fraction, "x").collect()}
    groups[None] = [1.0, 3.0]
    key = lambda v: (math.isnan(v), v if not math.isnan(v) else 0)
    want = {g: sorted(vs, key=key)[min(math.floor(len(vs) * fraction), len(vs) - 1)] for g, vs in groups.items()}
    assert repr(dict(sorted(got.items(), key=str))) == repr(dict(sorted(want.items(), key=str)))


def slow_levels(edges):
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
        out.setdefault(d, set())
    level, k = {}, 0
    while ready := [n for n in out if n not in level and all(d in level for d in out[n])]:
        level |= {n: 1 + max(level[d] for d in out[n]) if out[n] else 0 for n in ready}
        k += 1
    return {n: level.get(n) for n in out}


@pytest.mark.parametrize("shallow", [0, 3])
def test_levels_of_deep_graphs(spark, monkeypatch, shallow):
    monkeypatch.setattr(graphs, "_SHALLOW", shallow)
    rnd = random.Random(3)
    ladder = [(4 * i, 4 * i - d) for i in range(1, 40) for d in (1, 2)] + [(4 * i - d, 4 * i - 4) for i in range(1, 40) for d in (1, 2)]
    cases = [ladder, [(1, 1)], [(1, 2), (2, 1), (3, 1), (3, 4)]]
    for k in range(2):
        n = rnd.randint(3, 40)
        e = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(60)]
        e = [(max(a, b), min(a, b)) for a, b in e if a != b] if k else e
        cases.append(e + [(100 + i, 99 + i) for i in range(1, 20)] + [(99, rnd.randrange(n))] + [(200, 201), (201, 200), (202, 200)])
    for e in cases:
        assert {r.node: r.level for r in graphs.levels(spark.createDataFrame(e, "src long, dst long")).collect()} == slow_levels(e)


def test_a_chain_takes_a_round_for_each_doubling(spark, monkeypatch):
    chain = spark.range(4096).selectExpr("id + 1 AS src", "id AS dst")
    staged, n = graphs.staged, []
    monkeypatch.setattr(graphs, "staged", lambda df: n.append(1) or staged(df))
    assert {r.node: r.level for r in graphs.levels(chain).collect()} == {i: i for i in range(4097)}
    assert len(n) < 70  # tables written in all, not one for each level
