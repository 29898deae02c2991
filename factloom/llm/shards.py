"""Sharding as a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one group, and groups are ordered by the MD5 of their text. The smallest capacity for
which a greedy pass needs no more than the given number of shards is found by binary search, and the groups are cut
where that pass cuts. The pass never sees single groups: it runs over ranges of the order, as a table of their sums,
and only ranges in which a cut may fall are divided further, until every cut falls between two groups.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.ranges import partition_offsets, range_sorted
from factloom.llm.shared import stage, unstage

#: Hexadecimal digits of the key by which a range is divided at a time, and ranges whose sums are asked for at a time: the
#: driver gets at most 16 sums for each of them.
FIRST_DIGITS, DIGITS, ASKED = 3, 1, 512
KEY_DIGITS = 32


@dataclass(frozen=True)
class Range:
    """Groups whose key starts with ``prefix``; ``groups`` of them, ``size`` in all, the largest ``most``."""

    prefix: str
    size: int
    groups: int
    most: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or len(self.prefix) == KEY_DIGITS


def shards_needed(ranges: list[Range], ends: list[int], capacity: int, hopeful: bool) -> tuple[int, list[int]]:
    """Shards of a greedy pass and its cuts as running sums. A cut inside a range that isn't atomic is put where the
    shard is full if ``hopeful``, else before the range, as far as that is not the shard's own start."""
    cuts, start, total = [], 0, ends[-1] if ends else 0
    while total - start > capacity:
        want = start + capacity
        i = bisect_right(ends, want)  # the range in which the cut falls
        before = ends[i - 1] if i else 0
        cut = want if hopeful and not ranges[i].atomic else before
        if cut <= start:
            return 1 << 60, cuts
        cuts.append(cut)
        start = cut
    return len(cuts) + 1, cuts


def smallest_capacity(ranges: list[Range], shards: int, hopeful: bool) -> int:
    ends = list(accumulate(r.size for r in ranges))
    total = ends[-1] if ends else 0
    low, high = max([-(-total // shards), *(r.most for r in ranges)]), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if shards_needed(ranges, ends, mid, hopeful)[0] <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity for ``groups`` (key, size), and for each shard but the first the least key it holds."""

    def sums(prefixes: list[str], digits: int) -> list[Range]:
        found = groups
        if prefixes:
            found = found.filter(F.col("key").substr(1, len(prefixes[0])).isin(prefixes))
        rows = found.groupBy(F.col("key").substr(1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("most"))
        return [Range(r.prefix, r.size, r.groups, r.most) for r in rows.collect()]

    ranges = sorted(sums([], FIRST_DIGITS), key=lambda r: r.prefix)
    while True:
        low, high = smallest_capacity(ranges, shards, True), smallest_capacity(ranges, shards, False)
        ends = list(accumulate(r.size for r in ranges))
        first, last = shards_needed(ranges, ends, low, False)[1], shards_needed(ranges, ends, high, True)[1]
        open_ = set()
        if low < high:
            # the largest range first of all: it alone may keep the two capacities apart
            open_ |= {i for i, r in enumerate(ranges) if not r.atomic and r.size > 4 * ends[-1] / max(len(ranges), 1)}
        for k in range(max(len(first), len(last))):
            a = first[k] if k < len(first) else (last[k] if k < len(last) else ends[-1])
            b = last[k] if k < len(last) else ends[-1]
            lo, hi = bisect_right(ends, min(a, b)), bisect_right(ends, max(a, b))
            open_ |= {i for i in range(max(0, lo - 1), min(hi + 1, len(ranges))) if not ranges[i].atomic}
        if not open_:
            capacity = smallest_capacity(ranges, shards, False)
            cuts = shards_needed(ranges, ends, capacity, False)[1]
            starts = dict(zip([0, *ends], [r.prefix for r in ranges]))
            return capacity, [starts[c] for c in cuts]
        opened = sorted(open_, key=lambda i: -ranges[i].size)[:ASKED]
        by_length: dict[int, list[str]] = {}
        for i in opened:
            by_length.setdefault(len(ranges[i].prefix), []).append(ranges[i].prefix)
        fine = [r for n, prefixes in by_length.items() for r in sums(prefixes, min(KEY_DIGITS, n + DIGITS))]
        ranges = sorted([r for i, r in enumerate(ranges) if i not in set(opened)] + fine, key=lambda r: r.prefix)


def shard_documents(docs: DataFrame, shards: int, partitions: int | None = None) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into one of ``shards`` contiguous shards of near equal size.

    Size is the UTF-8 bytes of the text, none for a null text, plus 8. Equal texts stay together; a null text
    counts as an empty one. Returns doc_id, size, text_crc32, law, shard, slot and grown_shard, a row for every
    input row: repeated rows and null ids keep their own slots. Slots follow doc_id within a shard, nulls first. An
    empty table gives none. With fewer groups than shards the last shards stay empty. Other columns are not read.
    """
    spark = docs.sparkSession
    narrow = stage(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.md5(F.coalesce("text", F.lit(""))).alias("key"),
        ),
        "shard-rows",
    )
    groups = stage(narrow.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, starts = minimax_cuts(groups, shards)
    unstage(groups)
    shard = F.lit(0)
    for k, start in enumerate(starts, 1):
        shard = F.when(F.col("key") >= start.ljust(KEY_DIGITS, "0"), k).otherwise(shard)
    placed = narrow.withColumn("shard", shard).withColumn("tie", F.hash("text_crc32", F.monotonically_increasing_id()))
    ordered = range_sorted(placed.drop("key"), ["shard", "doc_id", "tie"], partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "shard-slots")
    unstage(narrow)
    # where each shard starts in each partition, and how many of its rows lie in the partitions before
    first = ordered.groupBy("_part", "shard").agg(F.min("_row").alias("_first"))
    offsets = partition_offsets(ordered, ["shard"], F.count("*")).join(first, ["_part", "shard"]).select("_part", "shard", "_before", "_first")
    slots = ordered.join(F.broadcast(offsets), ["_part", "shard"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_row") - F.col("_first") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
