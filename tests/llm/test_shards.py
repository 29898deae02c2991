import random
import zlib
from collections import defaultdict

from factloom.llm.shards import shard_documents


def capacity_by_brute_force(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, used = (low + high) // 2, 1, 0
        for s in sizes:
            if used + s > mid:
                n, used = n + 1, 0
            used += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def check(rows, out, shards):
    import hashlib

    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    groups = defaultdict(int)
    for _, t in rows:
        key = hashlib.md5((t or "").encode()).hexdigest()
        groups[key] += len((t or "").encode()) + 8
    loads, slots, home = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in out:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        home[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in home.values())
    assert set(loads) <= set(range(shards))
    assert max(loads.values()) == capacity_by_brute_force([groups[k] for k in sorted(groups)], shards)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None


def test_smallest_capacity_and_gapless_slots(spark):
    rnd = random.Random(5)
    for n, shards in ((1, 24), (7, 3), (3000, 24), (400, 24)):
        rows = [(i, "t%d " % rnd.randrange(n) * rnd.choice([1, 1, 5, 300])) for i in range(n)]
        out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        check(rows, out, shards)


def test_hot_group_nulls_repeats_and_empty(spark):
    rows = [(i, "same text") for i in range(500)] + [(None, None), (None, None), (3, ""), (3, ""), (4, "é")] + [(i, f"x{i}") for i in range(900)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, size int, key string")
    out = shard_documents(docs, 24).collect()
    check(rows, out, 24)
    assert next(r for r in out if r.doc_id == 4).text_crc32 in {zlib.crc32(b"x4"), zlib.crc32("é".encode()), zlib.crc32(b"same text")}
    assert shard_documents(docs.limit(0), 24).count() == 0
