import math
import random
from fractions import Fraction

from factloom.llm.topk import finite_vectors, top_k


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, qv in ok:
        if qi % every:
            continue
        held = lambda s: max(-(2**63), min(2**63 - 1, s))  # noqa: E731  a score is a long
        scored = sorted((-held(sum(a * b for a, b in zip(qv, cv))), ci) for ci, cv in ok if ci != qi and len(cv) == len(qv))
        out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, block=64):
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    vectors = finite_vectors(df)
    return sorted(tuple(r) for r in top_k(vectors.filter("vec_id % 5 = 0"), vectors, k, block, 1024).collect())


def test_many_tiles_with_ties(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(1500)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [float("nan"), 1.0]), (20, [float("inf"), 0.0]), (25, [1.0]), (30, []), (None, [1.0, 1.0]),
            (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5]), (35, [1e30, 1e30]), (36, [1e30, -3e30]), (31, []), (40, [1e307, 1.7e308]), (41, [1.7e308, -1e307])]
    got = run(spark, rows)
    assert got == brute(rows, 5, 5)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
