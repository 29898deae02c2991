import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import nearest, similarity


def slow_similar(rows, asked, k):
    out = []
    for i in asked:
        owner, tokens, sketch = rows[i]
        found = []
        for j, (o, t, s) in rows.items():
            both = len(set(sketch) & set(s))
            if o != owner and both and max(1, tokens // 3) <= t <= max(3, 3 * tokens):
                found.append((-round(both / min(len(set(sketch)), len(set(s))), 6), abs(t - tokens), o, j))
        out += [(i, j, -s, r) for r, (s, _, _, j) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("often", [3, 12, 10_000])
def test_retrieval_over_hot_members(spark, often):
    """Members that every row has, or a third of them, and rows that have nothing else."""
    rnd = random.Random(often)
    rows = {}
    for i in range(240):
        rare = [f"r{rnd.randrange(400)}" for _ in range(rnd.randint(0, 6))]
        hot = [h for h in ("all", "most", "third") if h == "all" or rnd.random() < (0.8 if h == "most" else 0.3)]
        rows[i] = (rnd.choice("abc"), rnd.choice([3, 10, 11, 12, 30, 90, 100]), rare + hot if rnd.random() < 0.9 else [])
    rows |= {i: rows[5] for i in range(300, 320)}  # copies
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()], "id long, owner string, tokens long, sketch array<string>")
    got = similarity.similar(df.filter("id % 7 = 0"), df, 4, often=often)
    assert Counter((r.left_id, r.right_id, r.similarity, r["rank"]) for r in got.collect()) == slow_similar(rows, [i for i in rows if i % 7 == 0], 4)


def test_overlapping_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, ["hot", *{f"m{rnd.randrange(25)}" for _ in range(rnd.randint(0, 8))}]) for i in range(80)]
    got = similarity.overlapping_pairs(spark.createDataFrame(rows, "id long, m array<string>"), "m", 3).collect()
    want = {(a, b, len(set(x) & set(y))) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= 3}
    assert {(r.left_id, r.right_id, r.shared) for r in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(9)
    rows = [(i, 0 if i % 3 else rnd.randrange(4), [rnd.randint(-4, 4) * (20.0 if i % 50 == 0 else 1.0) for _ in range(6)]) for i in range(2600)]
    rows += [(5000 + i, 0, rows[7][2]) for i in range(5)] + [(6000, 0, [1.0, 2.0]), (6001, 0, [3.0, 1.0]), (6002, 1, None), (6003, None, [1.0] * 6)]
    return rows, spark.createDataFrame(rows, "id long, grp long, v array<double>").repartition(3)


def test_greatest_products(vectors):
    rows, df = vectors
    got = nearest.greatest_products(df.filter("id % 100 = 0"), df, 3).collect()
    want = []
    for i, g, v in rows:
        if i % 100 == 0 and v and g is not None:
            found = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, h, w in rows if w and h == g and j != i and len(w) == len(v))
            want += [(i, j, -s, r) for r, (s, j) in enumerate(found[:3], 1)]
    assert Counter((r.id, r.known_id, r.score, r["rank"]) for r in got) == Counter(want)
    assert nearest.greatest_products(df.limit(0), df, 3).count() == 0 and nearest.greatest_products(df.limit(5), df.limit(0), 3).count() == 0


def test_nearest_of_groups(vectors):
    rows, df = vectors
    got = nearest.nearest_of_groups(df.filter("id % 100 = 0").select("id", "v"), df.withColumnRenamed("id", "known_id"), 1.0).collect()
    want = []
    for i, _, v in rows:
        if i % 100 == 0 and v:
            best = {}
            for j, h, w in rows:
                if w and h is not None and j != i and len(w) == len(v):
                    d = sum(abs(x - y) for x, y in zip(v, w)) / len(v)
                    if d <= 1.0:
                        best.setdefault(h, []).append((d, j))
            want += [(i, h, d, j) for h, all_ in best.items() for d, j in all_ if d == min(all_)[0]]
    assert Counter((r.id, r.grp, r.d, r.known_id) for r in got) == Counter(want) and want
