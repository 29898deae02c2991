"""Queries that no SQL twin covers, against slow versions over the smallest tables."""

import hashlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from factloom import catalog


def turns(spark, sf):
    rows = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    cut = {k: t.replace("\n", ".").split(".") for k, t in rows.items()}
    return rows, {k: (cut[k], cut[k[0], k[1] + 1]) for k in cut if (k[0], k[1] + 1) in cut}


def slow_align(a, b):
    """Least cost, and the ways to it, by looking at all ways to the ends."""

    @lru_cache(None)
    def at(i, j):
        if i == 0 or j == 0:
            return i + j, 1
        options = [(at(i - 1, j - 1), 0 if a[i - 1] == b[j - 1] else 1), (at(i - 1, j), 1), (at(i, j - 1), 1)]
        least = min(c + step for (c, _), step in options)
        return least, min(1 << 30, sum(w for (c, w), step in options if c + step == least))

    return at(len(a), len(b))


def slow_blocks(a, b):
    """Matching blocks: the longest common run (first in a, then in b), then the same on both sides of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    i, j, n = best
    if not n:
        return []
    return slow_blocks(a[:i], b[:j]) + [(i, j, n)] + [(x + i + n, y + j + n, k) for x, y, k in slow_blocks(a[i + n :], b[j + n :])]


def slow_changes(a, b):
    added = removed = changed = 0
    i = j = 0
    for x, y, n in [*slow_blocks(a, b), (len(a), len(b), 0)]:
        if x > i and y > j:
            changed += max(x - i, y - j)
        elif x > i:
            removed += x - i
        else:
            added += y - j
        i, j = x + n, y + n
    return added, removed, changed


def test_alignments_blocks_and_changes(spark, sf):
    _, pairs = turns(spark, sf)
    out = {(r.conv_id, r.turn): r for r in catalog.QUERIES["f12_alignment"](spark, sf).collect()}
    distance = {(r.conv_id, r.turn): r.distance for r in catalog.QUERIES["f13_block_distance"](spark, sf).collect()}
    changes = {(r.conv_id, r.turn): (r.added, r.removed, r.changed) for r in catalog.QUERIES["f14_change_vector"](spark, sf).collect()}
    assert out.keys() == distance.keys() == changes.keys() == pairs.keys()
    for k, (a, b) in pairs.items():
        share = 1 - 2 * sum(n for _, _, n in slow_blocks(a, b)) / (len(a) + len(b))
        assert (out[k].cost, out[k].ways) == slow_align(tuple(a), tuple(b))
        assert out[k].blocks == pytest.approx(share) and distance[k] == pytest.approx(share)
        assert (out[k].added, out[k].removed, out[k].changed) == slow_changes(a, b) == changes[k]


def test_novelty_keys(spark, sf):
    rows, _ = turns(spark, sf)
    out = {(r.conv_id, r.turn): r.novelty for r in catalog.QUERIES["f9_novelty_key"](spark, sf).collect()}
    for k, t in rows.items():
        names, words = [], []
        for w in t.split(" "):
            if len(w) > 3:
                if w not in names:
                    names.append(w)
                w = f"r{names.index(w)}"
            words.append(w)
        assert out[k] == hashlib.sha256(" ".join(words).encode()).hexdigest(), k


def test_grown_neighbourhood(spark, sf):
    part = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    near = {}
    for k, r in part.items():
        for other in {k // 3} | ({k // 2} if r.p_size > 40 else set()):
            if k > 0:
                near.setdefault(k, set()).add(other)
                near.setdefault(other, set()).add(k)
    heaviest = lambda ks: min(ks, key=lambda k: (-part[k].p_retailprice, k))
    taken = [heaviest(part)]
    while len(taken) < 6:
        front = {n for k in taken for n in near.get(k, ()) if n in part} - set(taken)
        if not front:
            break
        taken.append(heaviest(front))
    out = catalog.QUERIES["g10_grown_neighbourhood"](spark, sf).orderBy("step").collect()
    assert [r.node for r in out] == taken


def test_classifier_beats_chance_on_held_out_rows(spark):
    r = catalog.QUERIES["x10_trained_classifier"](spark, "/root/testdata/sf0.01").first()
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").filter("doc_id % 5 = 0")
    share = held.agg(F.avg("quality")).first()[0]
    assert r.auc > 0.6 and r.ap > share
