import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash
from factloom.llm.components import components


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_brute_force(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_fingerprints_and_components(spark):
    texts = [None, "", " \t", "One", "one Two", "A b c", "a B C d", "É x y z", "long " * 40_000 + "tail x y", "a\x1cb c\x85 d e"]
    rnd = random.Random(1)
    word = lambda: rnd.choice(["sun", "sea", "sky", "tree", "Rock", "sand", "é"])
    base = [" ".join(word() for _ in range(300)) for _ in range(12)]
    texts += base + [t + " sun" for t in base] + [t.replace("sun", "sea", 1) for t in base] + base[:3]
    rows = [(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "A b c", 1, "n"), (3, "One", 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, root string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = [slow_fingerprint(t) for _, t, _, _ in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((r[0], f"{f:016x}") for r, f in zip(rows, fps))
    parts = by_brute_force(fps)
    least = {}
    for (i, *_), p in zip(rows, parts):
        least[p] = min([x for x in (least.get(p), i) if x is not None], default=None)
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((r[0], least[p]) for r, p in zip(rows, parts))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_against_brute_force_and_crowded_keys(spark):
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(3):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                g ^= 1 << b
            fps.add(g)
    high = rnd.getrandbits(32) << 32
    fps |= {high | rnd.getrandbits(11) for _ in range(250)} | {high | rnd.getrandbits(32) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view("i8")),) for f in fps], "fp long")
    for most in (2048, 16):
        found = {r.node: r.root for r in components(simhash.links(df, most)).collect()}
        signed = [int(np.uint64(f).view("i8")) for f in fps]
        assert same_parts([found.get(s, s) for s in signed], by_brute_force(fps))


def test_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(201)} == {0} and {out[1000 + i] for i in range(300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
