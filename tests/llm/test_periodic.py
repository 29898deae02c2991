import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import grammar, periodic
from factloom.llm.queries import QUERIES


def slow_runs(w):
    """Every stretch of equal words q apart, for every q; those with a smaller period fall away."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            x = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - x + q
            if length >= max(6, 4 * q) and i > x and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(x, x + length - d)) for d in range(1, q)):
                out.append((x, length, q))
            i += i == x
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), s, m, q, m and 1000 * m // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequence(rnd):
    k = rnd.choice([1, 2, 2, 3, 4, 10])
    w = [rnd.randrange(k) for _ in range(rnd.randint(0, 120))]
    for _ in range(rnd.randint(0, 4)):
        block = [rnd.randrange(k) for _ in range(rnd.randint(1, 12))]
        at = rnd.randint(0, len(w))
        w[at:at] = [block[i % len(block)] for i in range(rnd.randint(1, 60))]
    return w


def test_runs_of_random_sequences():
    rnd = random.Random(1)
    for _ in range(800):
        w = sequence(rnd)
        assert [tuple(r) for r in grammar.runs(np.array(w, np.int64)).tolist()] == slow_runs(w), w


def test_grammar_derives_its_sequence_everywhere():
    rnd = random.Random(2)
    for _ in range(100):
        w = np.array([*sequence(rnd), -1, *sequence(rnd), -2], np.int64)
        g = grammar.Grammar(w)
        nodes = np.arange(len(g.start))
        of, at = g.places(nodes)
        for k, x in zip(of.tolist(), at.tolist()):
            a, m, b = g.start[k], g.mid[k], g.end[k]
            assert a < m < b and np.array_equal(w[x : x + b - a], w[a:b]) and (w[a:b] >= 0).all()
        # every two neighbours are parted by one node only
        inner = sorted(int(x + g.mid[k] - g.start[k]) for k, x in zip(of.tolist(), at.tolist()))
        assert inner == [i for i in range(1, len(w)) if w[i - 1] >= 0 and w[i] >= 0]


@pytest.mark.parametrize("period", [1, 2, 100, 60_001])
def test_long_periodic_texts(period):
    w = np.resize(np.random.default_rng(1).permutation(period), 300_000).astype(np.int64)
    assert grammar.runs(w).tolist() == [[0, 300_000, period]]
    g = grammar.Grammar(w)
    assert period > 2 or len(g.start) < 60  # a nonterminal for each doubling


def test_documents(spark, sf):
    rnd = random.Random(4)
    texts = [None, "", " \t\n", "one", "a " * 5, "a " * 6, "a b " * 4, "a b a b " * 7 + "é", "x y\x0bz x y\x0cz x y z x y z x y z"]
    texts += [" ".join("abcdefghij"[i] for i in sequence(rnd)) for _ in range(120)]
    rows = [(i, t, [1], "r") for i, t in enumerate(texts)] + [(None, "b a " * 9, None, None), (None, None, None, None), (4, "a " * 5, None, None), (4, "a " * 5, None, None), (10**12, "word " * 30_000 + "end", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, row string")
    found = periodic.periodic_runs(docs, periodic.repeated_tails)
    assert found.select("row.*").columns == docs.columns
    want = Counter(slow_row(r[0], r[1]) for r in rows[:-1])
    got = {r.doc_id: r for r in periodic.run_digests(found).collect()}
    assert Counter(tuple(r) for r in periodic.run_digests(found).filter("doc_id IS NULL OR doc_id < 1000").collect()) == want
    assert got[10**12].n_runs == 1 and got[10**12].length >= 7_500 and got[10**12].period == 1
    plain = {r.row.doc_id: r for r in periodic.periodic_runs(docs.filter("doc_id > 1000")).collect()}[10**12]
    assert plain.collapsed == "word end" and [tuple(r) for r in plain.runs] == [(0, 30_000, 1)] and plain.n_words == 30_001
    assert periodic.run_digests(periodic.periodic_runs(docs.limit(0))).count() == 0
    short = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 4000")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    ids = [r[0] for r in rows]
    assert Counter(tuple(r) for r in QUERIES["op11_grammar_runs"](spark, sf).collect() if r.doc_id in set(ids)) == Counter(slow_row(*r) for r in rows)
