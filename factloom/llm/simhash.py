"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprints within two bits of each other differ by at most one bit in one of their two halves. So each half is
indexed 32 times, each time with another bit wiped out (a wildcard); two halves that differ by at most one bit share
one of these keys. An equality join on the keys gives the candidates, which are then verified by their distance.
A key with very many fingerprints is divided by the same rule on the bits that it leaves open, until at most
2**11 fingerprints can share a key.

``near_duplicates`` links by the distance alone. ``similar_groups`` links texts by the similarity of their shingle sets:
pairs of near fingerprints are checked first, and pairs of similar sets whose fingerprints are further apart (two bits of
64 are reached from a similarity of about 0.96 on) are found by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import shingles
from factloom.llm.components import components
from factloom.llm.shared import packed, stage, text_batches

SEED, SHINGLE, BITS = 42, 3, 2
#: Fingerprints of one key that are compared at once; more are divided further. At least 2**11.
MOST = 2048
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """64 bits; each is 1 if it is set in over half of the hashes of the text's 3-word shingles, repeats included."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: A-Z only, ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    join, n = b" ".join, len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(join(s), SEED) for s in zip(words, words[1:], words[2:])), "u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its fingerprint as a signed long ``fp``."""
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(at)], "u8").view("i8")
            keep = [i for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(fps)], names=[*(batch.schema.names[i] for i in keep), "fp"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("fp", T.LongType()))


#: By how much a part of the fingerprint is shifted and how many bits it has, for each level of division. A level
#: halves what the key of the level before leaves open.
_PARTS = {0: [(32, 32), (0, 32)], 1: [(16, 16), (0, 16)], 2: [(8, 8), (0, 8)]}


def _keys(level: int) -> str:
    """SQL for the array of a level's keys: part, wildcard, and the part without that bit. ``open`` is what the key of
    the level before leaves open, shifted to the right."""
    keys = [f"({(p << 5 | j)}L << 32) | ((shiftrightunsigned(open, {shift}) & {(1 << bits) - 1}L) & {((1 << bits) - 1) & ~(1 << j)}L)" for p, (shift, bits) in enumerate(_PARTS[level]) for j in range(bits)]
    return f"array({', '.join(keys)})"


def set_fingerprint(hashes: np.ndarray) -> int:
    """64 bits; each is 1 if it is set in over half of a set's hashes; signed."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].astype(">i8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: pairs of distinct fingerprints within two bits, enough to join all that are linked."""
    rows = fps.select("fp", F.col("fp").alias("open"), F.lit(0).cast("long").alias("key"))
    found = None
    for level in _PARTS:
        sub = rows.withColumn("sub", F.explode(F.expr(_keys(level))))
        # the part that the new key doesn't hold stays open
        bits = _PARTS[level][0][1]
        rest = F.when(F.shiftright("sub", 37) == 0, F.col("open").bitwiseAND((1 << bits) - 1)).otherwise(F.shiftrightunsigned("open", bits).bitwiseAND((1 << bits) - 1))
        key = F.col("sub") if level == 0 else F.xxhash64("key", "sub")
        keyed = sub.select("fp", rest.alias("open"), key.alias("key"))
        # a key beyond the first level is a hash; fingerprints that share one by chance are told apart by their distance
        runs = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(_compare, most=most if level < 2 else MOST), "a long, b long, key long, open long")
        out = stage(runs, "simhash-links")
        edges = out.filter("key IS NULL").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rows = out.filter("key IS NOT NULL").select(F.col("a").alias("fp"), "open", "key")
        if rows.isEmpty():
            break
    return found.distinct()


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys, in order: links of a run, or its members with their key if there are too many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, last, over = 0, None, False
    for batch in batches:
        fp, open_, key = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("fp", "open", "key"))
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if key[i] != last:
                if n > 1 and not over:
                    yield from _linked(held)
                held, n, over, last = [], 0, False, key[i]
            if j - i == 1 and j < len(key) and not n:
                continue  # alone in its run
            held.append((fp[i:j], open_[i:j]))
            n += j - i
            if n > most:
                for f, o in held:
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.zeros_like(f)), pa.array(np.full(len(f), last)), pa.array(o)], names=["a", "b", "key", "open"])
                held, over = [], True
    if n > 1 and not over:
        yield from _linked(held)


def _linked(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in one run."""
    rest = np.unique(np.concatenate([f for f, _ in held]).view("u8"))
    a, b = [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= BITS
            if near.any():
                hit, rest = rest[near], rest[~near]
                a += [x] * len(hit)
                b += hit.tolist()
                front += list(hit)
    if a:
        a, b = np.array(a, "u8").view("i8"), np.array(b, "u8").view("i8")
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], names=["a", "b", "key", "open"])


def groups(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` but its text, with ``fp``, ``root`` and ``component_id``.

    ``root`` names the component; component_id is its smallest doc_id, null if none of its rows has one. Copies share a
    fingerprint and count once in the search. A null or empty text has the fingerprint zero. An empty table gives none.
    """
    rows = stage(fingerprints(docs), "fingerprints")
    # one row for each fingerprint; copies are gone before any link is looked for
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp")))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stage(nodes.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "fingerprint-groups")
    return rows.join(of, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document; see :func:`groups`."""
    found = groups(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, width: int = shingles.WIDTH, similarity: tuple[int, int] = shingles.SIMILARITY, common: int = shingles.COMMON) -> DataFrame:
    """row (a struct of the columns of ``docs``), id, digest, root, first: every row with the name of its group, and whether
    it has the group's smallest id and, of the texts with that id, the smallest digest.

    Texts are in one group if a chain of similar ones joins them: sets of ``width``-word shingles with a Jaccard similarity
    of at least ``similarity`` (a fraction). Texts without words, null ones included, are one group. ``id`` is doc_id as
    text, empty for null; null ids come last. Equal rows are all marked. An empty table gives none.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, nodes, fps = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles.shingle_set(text, width)
                digests.append(shingles.text_digest(text))
                nodes.append(shingles.set_name(h))
                fps.append(set_fingerprint(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "digest", "node", "fp"])

    marks = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest binary, node long, fp long"), "set-fingerprints")
    marks = marks.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "id")
    nodes = stage(marks.groupBy("node").agg(F.min("fp").alias("fp"), F.min(rank).alias("one")).select("node", "fp", "one"), "set-names")
    heads = stage(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
    near = links(heads.select("fp"))
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}")) for c in "ab")
    likely = near.join(a, "a").join(b, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    likely = likely.unionByName(nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
    texts = docs.select(packed(docs), "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), shingles.digest_column().alias("digest"))
    of = nodes.select("node", "one.digest", "one.id")
    roots = components(shingles.links(texts.select("text", "digest", "id"), of, likely, similarity, width, common))
    grouped = nodes.join(roots, "node", "left").select("node", "one", F.coalesce("root", "node").alias("root"))
    # the least of the groups' texts, and so the name of each text
    least = grouped.groupBy("root").agg(F.min("one").alias("least"))
    named = grouped.join(least, "root").select("node", "root", "least")
    of_text = marks.join(named, "node").select("id", "digest", "root", ((F.col("id") == F.col("least.id")) & (F.col("digest") == F.col("least.digest"))).alias("first")).distinct()
    return texts.drop("text").join(of_text, ["id", "digest"])
