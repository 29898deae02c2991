"""Target-distribution importance resampling.

Every run of words falls into one of a fixed number of buckets. The log ratio of a bucket's share in a target corpus and
in the documents is its gain; the gains are one array, and a document's weight is the sum over its features. A Gumbel
number of each document's own, added to the weight, makes the highest scores a draw without replacement in proportion to
the weights.

The k highest are found by a distributed quickselect: random pivots among the keys that are left, exact counts of keys
below and at each pivot in one pass, and on with the keys between the two pivots that hold the k-th. Keys are composite
(score, id, row), so no two are equal and the cut is exact. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.ranges import range_sorted
from factloom.llm.shared import packed, stage, text_batches, unstage

BUCKETS, WIDTH, SEED = 10_000, 1, 2024
#: Documents with fewer words aren't drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
#: Pivots of a round; keys left are divided by about so many.
PIVOTS = 16
#: Distinct words whose bucket a task remembers.
_REMEMBERED = 1 << 19
#: Bytes of words: digits, lower-case letters and all beyond ASCII; A-Z become lower-case, others a blank.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_KEY = ["neg", "last", "id", "at"]


class _Buckets(dict):
    """Word (bytes) to bucket, worked out once a word."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def _features(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The last column, a text's bytes, gives way to its number of words and features and the features' buckets."""
    of = _Buckets(buckets)
    for batch in batches:
        n_words, packs, counts = [], [], []
        for text in batch.column(batch.num_columns - 1):
            words = (text.as_py() or b"").translate(_WORD_BYTES).split()
            found = [of[w] for w in words]
            for k in range(2, width + 1):
                found += [zlib.crc32(b" ".join(words[i : i + k])) % buckets for i in range(len(words) - k + 1)]
            n_words.append(len(words))
            counts.append(len(found))
            packs.append(np.array(found, "<u4").tobytes() if buckets > 1 << 16 else np.array(found, "<u2").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(counts, pa.int64()), pa.array(packs, pa.binary())], names=[*batch.schema.names[:-1], "n_words", "n_features", "found"])


def _histogram(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, n of a task's documents: a row for each bucket at most."""
    kind, total = "<u4" if buckets > 1 << 16 else "<u2", np.zeros(buckets, np.int64)
    for batch in batches:
        for found in batch.column(0):
            total += np.bincount(np.frombuffer(found.as_py(), kind), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def _weights(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The last column, a document's buckets, gives way to its weight."""
    kind = "<u4" if len(gains) > 1 << 16 else "<u2"
    for batch in batches:
        weight = [int(gains[np.frombuffer(f.as_py(), kind)].sum()) for f in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())], names=[*batch.schema.names[:-1], "weight"])


def features(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """``rows``, whose last column is a text, with n_words, n_features and the buckets of the features (packed) in its place."""
    text_batches(rows.sparkSession)
    texts = rows.withColumn(rows.columns[-1], F.col(rows.columns[-1]).cast("binary"))
    schema = T.StructType([*rows.schema.fields[:-1]]).add("n_words", "long").add("n_features", "long").add("found", "binary")
    return texts.mapInArrow(partial(_features, width=width, buckets=buckets), schema)


def gains(found: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A bucket's gain, in thousandths: the log ratio of its shares in ``target`` and ``found`` (buckets, packed), one added to each count."""

    def counts(df: DataFrame) -> np.ndarray:
        sums = df.select("found").mapInArrow(partial(_histogram, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        out = np.zeros(buckets)
        for r in sums.collect():  # one row for each bucket
            out[r.bucket] = r.n
        return out

    s, t = counts(found), counts(target)
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def _literal(key: tuple) -> str:
    return f"named_struct({', '.join(f"'{c}', {int(v)}L" for c, v in zip(_KEY, key))})"


def select_key(keys: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (from 1) of the distinct ``keys`` (neg, last, id, at: long), None if there are fewer.

    Each round takes ``pivots`` of the keys left at random (by a hash, so reruns agree), counts the keys at each of them and
    between neighbours, and goes on with those between the two that hold the k-th. Keys left shrink by about that factor, so
    all rounds after the first read little; at most ``pivots`` keys left are all pivots, which ends it.
    """
    left, turn = keys.select(*_KEY, F.struct(*_KEY).alias("key")), 0
    while True:
        picked = sorted(tuple(r)[:4] for r in left.orderBy(F.xxhash64(*_KEY, F.lit(seed + turn)), *_KEY).limit(pivots).collect())
        if not picked:
            return None
        # two for each pivot below the key, and one for the pivot that it is: even places lie between pivots, odd ones at them
        those = f"array({', '.join(map(_literal, picked))})"
        placed = left.withColumn("place", F.expr(f"2 * size(filter({those}, p -> p < key)) + int(array_contains({those}, key))"))
        counts = {r.place: r.n for r in placed.groupBy("place").agg(F.count("*").alias("n")).collect()}
        for place in range(2 * len(picked) + 1):
            if k <= counts.get(place, 0):
                break
            k -= counts.get(place, 0)
        else:
            place = None  # fewer than k
        after = stage(placed.filter(F.col("place") == place).drop("place"), "resample-keys") if place is not None and place % 2 == 0 else None
        if turn:
            unstage(left)
        if after is None:
            return None if place is None else picked[place // 2]
        left, turn = after, turn + 1


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, width: int = WIDTH, buckets: int = BUCKETS, carried: list[str] | None = None) -> DataFrame:
    """row (a struct of the ``carried`` columns of ``docs``, by default all), n_words, n_features, weight, score and rank of
    every row of ``docs`` (doc_id, text and any others): rank 1, 2, 3... by score, highest first, ties to the smaller doc_id,
    for the ``percent`` drawn of all rows with ``least_words`` words or more, and null for the others.

    A null or empty text has no features and weighs 0. A null doc_id draws its number as the empty string and comes last in
    ties. Rows equal in score and doc_id are told apart by their places, so each counts and has a rank of its own. An empty
    ``docs`` gives none; with an empty ``target`` the gains only say how common a bucket is.
    """
    spark = docs.sparkSession
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carried]) if carried else docs), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    found = stage(features(rows, width, buckets), "resample-features")
    gain = gains(found, features(target.select("text"), width, buckets), buckets)
    schema = T.StructType([f for f in found.schema.fields if f.name != "found"]).add("weight", "long")
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    scored = found.mapInArrow(partial(_weights, gains=gain), schema).withColumn("score", F.col("weight") + gumbel)
    keys = {"neg": -F.col("score"), "last": F.col("_id").isNull().cast("long"), "id": F.coalesce(F.col("_id").cast("long"), F.lit(0)), "at": F.monotonically_increasing_id()}
    scored = stage(scored.withColumns(keys), "resample-scores")
    unstage(found)
    enough = scored.filter(F.col("n_words") >= least_words)
    k = percent * enough.count() // 100
    out = ["row", "n_words", "n_features", "weight", "score"]
    last = select_key(enough, k, seed) if k else None
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    wins = (F.col("n_words") >= least_words) & (F.struct(*_KEY) <= F.expr(_literal(last)))
    ranked = range_sorted(scored.filter(wins), _KEY, int(spark.conf.get("spark.sql.shuffle.partitions")), "resample-winners")
    before, offsets = 0, []
    for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row for each range
        offsets.append((r["_part"], before))
        before += r.n
    ranked = ranked.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _before long")), "_part")
    return scored.filter(~wins).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*out, (F.col("_before") + F.col("_row") + 1).alias("rank")))
