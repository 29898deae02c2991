import math
import random
import re

import pytest

from factloom.llm import mixing


def slow_targets(words):
    """Raise a common level until the mix is full."""
    names = sorted(words, key=lambda n: (n is None, n or ""))
    w = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    low, high = 0.0, 4.0 * sum(words.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(2 * words[n], mid * w[n]) for n in names) < 1.5 * sum(words.values()):
            low = mid
        else:
            high = mid
    return {n: min(2 * words[n], high * w[n]) for n in names}


def mixed(docs):
    return mixing.mixed(docs).select("row.*", "size", "source_size", "target", "rate", "copies", "taken").collect()


def slow_rates(out):
    """The dual's optimum by bisection: rates 2 / (1 + exp(-t size)) whose words meet the target."""
    of = {}
    for r in out:
        of.setdefault(r.source, []).append(r)
    for rows in of.values():
        target, low, high = rows[0].target, -50.0, 50.0
        if target >= 2 * rows[0].source_size:
            assert all(r.rate == 2 for r in rows if r["size"])
            continue
        rate = lambda t, n: 2 / (1 + math.exp(max(-700, min(700, -t * n))))
        for _ in range(200):
            t = (low + high) / 2
            low, high = (t, high) if sum(r["size"] * rate(t, r["size"]) for r in rows) < target else (low, t)
        for r in rows:
            assert r.rate == pytest.approx(rate(low, r["size"]) if r["size"] else 0, abs=1e-5)


def check(rows, out):
    assert len(out) == len(rows)
    words, taken = {}, {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = slow_targets(words)
    most = {}
    for r in out:
        assert r.source_size == words[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-6, abs=1e-6)
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= most[s] / 2 + 1e-6 * want[s], s


def test_targets_are_met_within_half_a_document(spark):
    rnd = random.Random(8)
    sources = ["a", "é", "b", None, "B", "c", "tiny"]
    rows = [(i, "w " * int(rnd.paretovariate(0.8) * 3), sources[min(6, int(rnd.expovariate(0.8)))]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixed(docs)
    check(rows, out)
    slow_rates(out)
    again = mixed(docs.repartition(7))
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c", None), (4, "one", "y"), (4, "one", "y"), (5, "w\x0bx\x1cy\x85z", "y"), (6, "v " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixed(docs)
    assert {(r.doc_id, r["size"]) for r in out} == {(1, 0), (2, 0), (None, 3), (4, 1), (5, 2), (6, 50_000)}
    assert all(r.copies <= 2 for r in out) and all(r.taken == 0 for r in out if not r["size"])
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(2)).count() == 2


def test_many_sources_and_clashing_columns(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(1, 30), f"s{rnd.randrange(400)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixed(docs))
    clash = mixing.mixed(docs.selectExpr("doc_id", "text", "source", "1 AS size", "2 AS target", "3 AS tilt", "4 AS _name")).select("row.*")
    assert clash.columns == ["doc_id", "text", "source", "size", "target", "tilt", "_name"] and clash.count() == 2000
