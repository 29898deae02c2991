"""Exact top-k search by tiled matrix products.

Queries and candidates are packed into bounded blocks. Every pair of a query block and a candidate block is one tile:
one matrix product, from which each query keeps its best few. The lists of a query block are then merged in a tree of
bounded fan-in. No task holds more than one tile or one merge, whatever the sizes of the two sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import stage

#: Vectors of a block of candidates, bytes of one of queries, and lists that one merge takes. Candidates are dealt out once for
#: each block of queries, so those are as large as a task's memory bears.
BLOCK, QUERY_BYTES, FAN_IN = 8192, 32 << 20, 16
_SAFE, _LONG = float(1 << 53), (1 << 63) - 1
_TOP = "query_block int, lane int, n int, query_id binary, vec_id binary, score binary"


def finite_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim and components as doubles. Rows without a vec_id, and vectors that are null
    or hold a null or a component that isn't finite, are left out; they can't be named or scored."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), x.alias("v"))


def pack(vectors: DataFrame, block: Column, name: str) -> DataFrame:
    """One row for each block and dimension: ids and components as bytes, in order of id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        dim = table.column("dim")[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if dim else np.empty(0)
        ids = table.column("vec_id").to_numpy()
        return pa.table({name: table.column(name).slice(0, 1), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
                         f"{name}_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), f"{name}_v": pa.array([flat.astype("<f8").tobytes()], pa.binary())})

    return vectors.withColumn(name, block.cast("int")).groupBy(name, "dim").applyInArrow(run, f"{name} int, dim int, n int, {name}_ids binary, {name}_v binary")


def products(q: np.ndarray, c: np.ndarray, scale: int = 1) -> np.ndarray:
    """Exact inner products of floor(scale * x): by floats where no sum can pass 2**53, else by whole numbers. A product
    beyond a long's range counts as the nearest long."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    with np.errstate(over="ignore"):
        a, b = np.floor(q * scale), np.floor(c * scale)
        safe = np.abs(a).max() * np.abs(b).max() * q.shape[1] < _SAFE
    if safe:
        return (a @ b.T).astype(np.int64)
    # a double that overflows when it is scaled is a whole number itself
    whole = [np.array([[int(s) if np.isfinite(s) else int(x) * scale for x, s in zip(*rows)] for rows in zip(of, scaled)], object) for of, scaled in ((q, a), (c, b))]
    return np.clip(whole[0] @ whole[1].T, -_LONG - 1, _LONG).astype(np.int64)


def best_of_tile(qids: np.ndarray, cids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best candidates, all if fewer, as parallel arrays. ``cids`` ascend, so of equal scores the
    first places win. Selection is partial: only candidates no worse than the k-th are sorted."""
    if scores.shape[1] > 4 * k:
        # the k-th best score of each row, and all that reach it
        kth = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1 :].min(axis=1)
        row, col = np.nonzero(scores >= kth[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), scores.shape[1])
    other = qids[row] != cids[col]
    row, col = row[other], col[other]
    s = scores[row, col]
    return keep_best(row, cids[col], s, k, qids)


def keep_best(group: np.ndarray, cids: np.ndarray, s: np.ndarray, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((cids, ~s, group))  # ~s descends and can't overflow
    group, cids, s = group[order], cids[order], s[order]
    place = np.arange(len(group)) - np.searchsorted(group, group, side="left")
    top = place < k
    return names[group[top]], cids[top], s[top]


def top_k(queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK, query_bytes: int = QUERY_BYTES, scale: int = 256) -> DataFrame:
    """The ``k`` candidates with the highest inner product of floor(scale * x) for each query, ties to the smaller vec_id.

    Both sides are as :func:`finite_vectors` gives them. Returns query_id, rank (from 1), vec_id and score. A
    candidate with the query's own vec_id doesn't count. Only vectors of equal length have a product. Rows that
    repeat a vec_id each count as candidates; queries that repeat one are answered once, by the best of their products.
    Empty sides give no rows. Scores beyond a long are held at its ends.
    """
    sides = {"query": queries, "lane": candidates}
    # what a block gets is dealt at random (seeded, so a rerun deals alike), as one id may have many rows
    rows = {name: side.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first() for name, side in sides.items()}
    per = {"query": max(1, query_bytes // (8 * max(1, rows["query"].dim))), "lane": block}
    counts = {name: max(1, -(-rows[name].n // per[name])) for name in sides}
    packed = {name: stage(pack(side, F.floor(F.rand(7) * counts[name]), name), f"blocks-{name}", "none") for name, side in sides.items()}
    q = packed["query"].withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(counts["lane"] - 1))))
    c = packed["lane"].withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(counts["query"] - 1))))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            a, b = left.to_pylist()[0], right.to_pylist()[0]
            qids, cids = np.frombuffer(a["query_ids"], "<i8"), np.frombuffer(b["lane_ids"], "<i8")
            qv, cv = (np.frombuffer(x, "<f8").reshape(n, a["dim"]) for x, n in ((a["query_v"], a["n"]), (b["lane_v"], b["n"])))
            step = max(1, (1 << 22) // len(cids))  # products held at a time
            parts = [best_of_tile(qids[i : i + step], cids, products(qv[i : i + step], cv, scale), k) for i in range(0, len(qids), step)]
            found = [np.concatenate(x).astype("<i8") for x in zip(*parts)]
            rows = [(a["query"], a["lane"], len(found[0]), *(x.tobytes() for x in found))]
        return _table(rows)

    tiles = q.groupBy("query", "lane", "dim").cogroup(c.groupBy("query", "lane", "dim")).applyInArrow(tile, _TOP)

    def merge(table: pa.Table) -> pa.Table:
        found = _merged(table.to_pylist(), k)
        first = table.slice(0, 1).to_pylist()[0]
        return _table([(first["query_block"], first["lane"], len(found[0]), *(x.astype("<i8").tobytes() for x in found))])

    left = counts["lane"]
    lists = tiles
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        lists = lists.withColumn("lane", F.expr(f"lane div {FAN_IN}").cast("int")).groupBy("query_block", "lane").applyInArrow(merge, _TOP)

    def last(table: pa.Table) -> pa.Table:
        qids, cids, s = _merged(table.to_pylist(), k)
        rank = np.arange(len(qids)) - np.searchsorted(qids, qids, side="left") + 1
        return pa.table({"query_id": pa.array(qids, pa.int64()), "rank": pa.array(rank, pa.int32()), "vec_id": pa.array(cids, pa.int64()), "score": pa.array(s, pa.int64())})

    return lists.groupBy("query_block").applyInArrow(last, "query_id long, rank int, vec_id long, score long")


def _merged(rows: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qids, cids, s = (np.concatenate([np.frombuffer(r[name], "<i8") for r in rows]) for name in ("query_id", "vec_id", "score"))
    names, group = np.unique(qids, return_inverse=True)
    return keep_best(group, cids, s, k, names)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (("query_block", pa.int32()), ("lane", pa.int32()), ("n", pa.int32()), ("query_id", pa.binary()), ("vec_id", pa.binary()), ("score", pa.binary()))
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})
