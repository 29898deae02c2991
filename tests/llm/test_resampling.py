import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from factloom.llm import resampling
from factloom.llm.queries import QUERIES


def slow(docs, target, percent=10, least=20, width=1, buckets=10_000):
    """doc_id, n_features, weight, score, rank by the definition."""

    def found(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return words, [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in found(t)[1])
    t = Counter(bucket(f) for x in target for f in found(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for at, (i, text) in enumerate(docs):
        words, fs = found(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, len(words) >= least])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_against_brute_force_with_nulls_ties_and_clashing_columns(spark):
    rnd = random.Random(3)
    words = ["Sun", "sea", "sky42", "é", "tree", "ROCK", "naïve", "x", "İ", "don't", "co-op", "\x7f", " q"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(rnd.randint(0, 60))) for i in range(150)] + [(None, text(30)), (None, None), (900, None), (901, ""), (902, "word " * 60_000)]
    rows += [(7, "sun sky42 " * 20)] * 30 + [(None, "sun " * 25)] * 5
    docs = spark.createDataFrame([(*r, 1.5, "a", "b") for r in rows], "doc_id long, text string, score double, rank string, at string").repartition(5)
    target = ["the sun and the sky42", None, "", "Sun sky42 sea"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for kw in ({"percent": 37}, {"percent": 50, "width": 3, "buckets": 1000}, {"percent": 100}, {"percent": 0}):
        out = resampling.resampled(docs, bench, **kw)
        assert out.columns == ["row", "n_words", "n_features", "weight", "score", "rank"] and out.select("row.*").columns == docs.columns
        got = Counter(tuple(r) for r in out.select("row.doc_id", "n_features", "weight", "score", "rank").collect())
        assert got == slow(rows, target, **kw)
    assert resampling.resampled(docs.limit(0), bench).count() == 0
    got = resampling.resampled(docs, bench.limit(0)).select("row.doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == slow(rows, [])


def test_the_key_of_every_place(spark):
    rnd = random.Random(5)
    keys = [(rnd.randint(-5, 5), rnd.randint(0, 1), rnd.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(keys, "neg long, last long, id long, at long").repartition(3)
    for k in (1, 2, 57, 399, 400):
        assert resampling.select_key(df, k, pivots=7) == sorted(keys)[k - 1]
    assert resampling.select_key(df, 401, pivots=7) is None and resampling.select_key(df.limit(0), 1) is None


def test_query_on_the_smallest_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_target_resampling"](spark, sf).collect()) == slow(docs, target)
    assert QUERIES["op13_target_resampling"](spark, sf).filter(F.col("rank").isNotNull()).count() > 10
