import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import intervals


def slow(costs, budget):
    out = []
    for at, c in enumerate(costs):
        if c is not None and 0 <= c <= budget:
            budget -= c
            out.append(at)
    return out


@pytest.mark.parametrize("kind", ["random", "halving", "rising", "just too large", "nulls and nothing", "many blocks", "never fits"])
def test_equal_to_the_fold(spark, kind):
    rnd = random.Random(kind)
    n = 400
    costs, budget = {
        "random": ([rnd.randint(0, 90) for _ in range(n)], 1500),
        "halving": ([x for k in range(20, 0, -1) for x in ((1 << k) + 1, 1 << k, (1 << k) - 1)], 1 << 20),
        "rising": ([k // 2 for k in range(n)], 9000),
        # each large one misses by one, each small one fits
        "just too large": ([x for k in range(100) for x in (1, 1000 - k)], 1000),
        "nulls and nothing": ([rnd.choice([None, 0, -3, 5, 1 << 40]) for _ in range(n)], 100),
        "many blocks": ([rnd.choice([1, 2, 3, 70, 900]) for _ in range(n)], 800),
        "never fits": ([100] * 50, 99),
    }[kind]
    df = spark.createDataFrame([(k, c, -1) for k, c in enumerate(costs)], "k long, c long, n int").repartition(3)
    out = intervals.skipping_budget_of_all(df, [F.asc("k")], "c", budget, block_rows=7)
    assert out.columns == df.columns and sorted(r.k for r in out.collect()) == slow(costs, budget)


def test_empty_and_no_budget(spark):
    df = spark.createDataFrame([(1, 0), (2, 5)], "k long, c long")
    assert [r.k for r in intervals.skipping_budget_of_all(df, [F.asc("k")], "c", 0).collect()] == [1]
    assert intervals.skipping_budget_of_all(df.limit(0), [F.asc("k")], "c", 5).count() == 0
    assert intervals.skipping_budget_of_all(df, [F.asc("k")], "c", -1).count() == 0
