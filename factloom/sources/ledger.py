"""A ledger whose entries each hold the digest of the one before, in segments that are verified side by side.

Within a segment every entry's digest is of the one before and its content, from a start that depends on the segment's number
alone. A segment's head is the digest of the head before and of its last entry, so the heads, a row for each segment, chain
the segments. Whoever changes an entry has to change the segment's end and every head from there on. Appending compares the last
head with the one that the writer has seen, and is one version of the store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.order import numbered
from factloom.sources.staging import staged
from factloom.sources.store import Refused, Store

GENESIS = hashlib.sha256(b"").hexdigest()
ENTRIES = "segment long, place long, content string, digest string"
HEADS = "segment long, first_place long, last_place long, end string, head string"


def link(before: str, content: str | None) -> str:
    """Digest of an entry or a head; a null content is another one than an empty one."""
    return hashlib.sha256(f"{before}\n{'-' if content is None else '+' + content}".encode()).hexdigest()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, place, content), each segment in order, with their digests."""
    segment, last = None, ""
    for batch in batches:
        digests = []
        for s, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if s != segment:
                segment, last = s, link(GENESIS, str(s))
            last = link(last, content)
            digests.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["segment", "place", "content", "digest"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment, n, first_place, last_place, end (as computed) and the first place whose digest is another, of each segment's rows (segment, place, content, digest)."""
    now: list | None = None
    done = []
    for batch in batches:
        for s, place, content, digest in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or s != now[0]:
                if now is not None:
                    done.append(now)
                now = [s, 0, place, place, link(GENESIS, str(s)), None]
            now[1] += 1
            now[3], now[4] = place, link(now[4], content)
            if now[5] is None and now[4] != digest:
                now[5] = place
    if now is not None:
        done.append(now)
    names = ["segment", "n", "first_place", "last_place", "end", "wrong"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=names)


class Ledger:
    """Tables ``name`` (segment, place, content, digest) and ``name``_heads of a store. A segment has ``size`` entries; the last one of
    each change may have fewer."""

    def __init__(self, store: Store, name: str, size: int = 10_000):
        self.store, self.name, self.size = store, name, size

    def _last(self) -> tuple[int, int, str]:
        """Segments, entries and the last head."""
        if self.store.current(f"{self.name}_heads") is None:
            return 0, 0, GENESIS
        r = self.store.read(f"{self.name}_heads").agg(F.max(F.struct("segment", "last_place", "head"))).first()[0]
        return r.segment + 1, r.last_place + 1, r.head

    def head(self) -> str:
        return self._last()[2]

    def append(self, entries: DataFrame, order: list[Column], seen: str) -> str:
        """Add ``entries`` (content, string, and what ``order`` needs) in that order; returns the new head. It is refused if
        ``seen`` isn't the last head any more."""
        segments, places, last = self._last()
        if last != seen:
            raise Refused(f"{self.name}: the ledger has gone on")
        at = numbered(entries, order, "_at")
        rows = at.select((F.floor(F.col("_at") / self.size) + segments).alias("segment"), (F.col("_at") + places).alias("place"), "content")
        chained = staged(rows.repartition("segment").sortWithinPartitions("segment", "place").mapInArrow(_chained, ENTRIES))
        ends = chained.groupBy("segment").agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.max_by("digest", "place").alias("end"))
        heads = []
        for r in ends.orderBy("segment").collect():  # a row for each segment
            last = link(last, r.end)
            heads.append((r.segment, r.first_place, r.last_place, r.end, last))
        if heads:
            self.store.append_all({f"{self.name}_heads": (self.store.spark.createDataFrame(heads, HEADS), ["segment"]), self.name: (chained, ["place"])})
        return last

    def broken(self) -> DataFrame:
        """segment, place, why: ``entry``, the first entry of a segment that isn't what its digest says; ``segment``, one whose entries aren't those
        of its head, by their places or their end; ``head``, one that doesn't go on from the one before."""
        entries, heads = self.store.read(self.name), self.store.read(f"{self.name}_heads")
        found = entries.select("segment", "place", "content", "digest").repartition("segment").sortWithinPartitions("segment", "place")
        found = found.mapInArrow(_checked, "segment long, n long, first_place long, last_place long, end string, wrong long")
        told = heads.select("segment", *[F.col(c).alias(f"_{c}") for c in ("first_place", "last_place", "end", "head")])
        before = heads.select((F.col("segment") + 1).alias("segment"), F.col("head").alias("_before"), (F.col("last_place") + 1).alias("_next"))
        both = found.join(told, "segment", "full_outer").join(before, "segment", "left")
        first = F.col("segment") == 0
        start, go_on = F.when(first, F.lit(0)).otherwise(F.col("_next")), F.when(first, F.lit(GENESIS)).otherwise(F.col("_before"))
        fits = (F.col("first_place") == F.col("_first_place")) & (F.col("last_place") == F.col("_last_place")) & (F.col("n") == F.col("last_place") - F.col("first_place") + 1) & (F.col("end") == F.col("_end"))
        linked = (F.sha2(F.concat(go_on, F.lit("\n+"), "_end"), 256) == F.col("_head")) & (F.col("_first_place") == start)
        why = F.when(F.col("wrong").isNotNull(), "entry").when(~F.coalesce(fits, F.lit(False)), "segment").when(~F.coalesce(linked, F.lit(False)), "head")
        return both.select("segment", F.coalesce("wrong", "_first_place", "first_place").alias("place"), why.alias("why")).filter("why IS NOT NULL")
