"""Nearest vectors of a query set, exactly, by bounded tiles.

Vectors are packed into blocks in the order of their norm; a tile is a block of queries against a block of known vectors. The
norms bound what a tile can hold, so a scan leaves out blocks that can't reach what has been found, and ends where none behind
it can. Queries are staged and read by every task that holds known vectors, a block at a time: nothing is copied and no key is joined on,
so a group that has most of the rows is like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.files import file_system
from factloom.sources.staging import staged

#: Vectors of a block, and numbers of a tile's differences that are worked on at once.
BLOCK, _NUMBERS = 1024, 1 << 21


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _query_blocks(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of the staged queries, file by file."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, folder = file_system(path)
    for info in sorted(fs.get_file_info(FileSelector(folder)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as stream:
                yield from pq.ParquetFile(stream).iter_batches(BLOCK, columns=columns)


def _blocks(batches: Iterator[pa.RecordBatch], norm) -> dict[int, list[tuple]]:
    """Known vectors by their length: blocks (ids, groups, matrix, norms) in descending norm."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, groups, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        sizes = vectors.value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            held.setdefault(size, []).append((ids[at], groups[at], _matrix(vectors.take(pa.array(at)), size)))
    out = {}
    for size, parts in held.items():
        ids, groups, m = (np.concatenate([p[k] for p in parts]) for k in range(3))
        norms = norm(m)
        order = np.argsort(-norms, kind="stable")
        out[size] = [(ids[o], groups[o], m[o], norms[o]) for o in np.split(order, range(BLOCK, len(order), BLOCK))]
    return out


def _products(batches: Iterator[pa.RecordBatch], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k greatest inner products of each query with this task's vectors of its group."""
    length = lambda m: np.sqrt((m * m).sum(1))
    known = _blocks(batches, length)
    for queries in _query_blocks(path, ["id", "grp", "v"]) if known else ():
        sizes = queries.column(2).value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            ids, groups, q = queries.column(0).to_numpy()[at], queries.column(1).to_numpy()[at], _matrix(queries.column(2).take(pa.array(at)), size)
            own, best = length(q), [[] for _ in at]
            least = np.full(len(at), -np.inf)
            for other, of, m, norms in known.get(size, []):
                # no product with this block or one behind it is larger than that
                bound = own * norms[0] * (1 + 1e-12)
                open_ = np.flatnonzero(bound >= least)
                if not len(open_):
                    break
                open_ = open_[np.isin(groups[open_], of)]
                if not len(open_):
                    continue
                scores = q[open_] @ m.T
                for row, x in zip(scores, open_.tolist()):
                    fits = np.flatnonzero((of == groups[x]) & (other != ids[x]) & (row >= least[x]))
                    top = sorted(best[x] + list(zip((-row[fits]).tolist(), other[fits].tolist())))[:k] if len(fits) <= 4 * k else sorted(best[x] + [(-row[i], int(other[i])) for i in fits[np.lexsort((other[fits], -row[fits]))[:k]]])[:k]
                    best[x] = top
                    if len(top) == k:
                        least[x] = -top[-1][0]
            rows = [(int(ids[x]), i, -s) for x, top in enumerate(best) for s, i in top]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["id", "known_id", "score"])


def greatest_products(queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """id, known_id, score, rank: for each query (id, grp, v) the ``k`` greatest inner products with known vectors (id, grp, v) of its
    group and length, its own id left out; ties to the smaller id. Ids and groups are whole numbers, vectors arrays of numbers
    without nulls."""
    cast = [F.col("id").cast("long").alias("id"), F.col("grp").cast("long").alias("grp"), F.col("v").cast("array<double>").alias("v")]
    asked = staged(queries.select(*cast).filter("v IS NOT NULL AND grp IS NOT NULL"))
    found = known.select(*cast).filter("v IS NOT NULL AND grp IS NOT NULL").mapInArrow(partial(_products, path=asked.staged_path, k=k), "id long, known_id long, score double")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "known_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _distances(batches: Iterator[pa.RecordBatch], path: str, most: float) -> Iterator[pa.RecordBatch]:
    """The least mean absolute difference of each query to this task's vectors of each group, with the vectors that have it."""
    total = lambda m: np.abs(m).sum(1)
    known = _blocks(batches, total)
    for queries in _query_blocks(path, ["id", "v"]) if known else ():
        sizes = queries.column(1).value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            ids, q = queries.column(0).to_numpy()[at], _matrix(queries.column(1).take(pa.array(at)), size)
            own = total(q)
            best: dict[tuple[int, int], tuple[float, list[int]]] = {}
            slack = size * most * (1 + 1e-9)
            for other, of, m, norms in known.get(size, []):
                if norms[0] < own.min() - slack:
                    break  # sums of absolute values differ by the distance at most, and those behind are smaller still
                open_ = np.flatnonzero((own - slack <= norms[0]) & (own + slack >= norms[-1]))
                step = max(1, _NUMBERS // (len(m) * max(size, 1)))
                for x in (open_[i : i + step] for i in range(0, len(open_), step)):
                    d = np.abs(q[x, None, :] - m[None, :, :]).sum(2) / size if size else np.zeros((len(x), len(m)))
                    for row, y in zip(d, x.tolist()):
                        near = np.flatnonzero((row <= most) & (other != ids[y]))
                        for i in near.tolist():
                            key = (y, int(of[i]))
                            had = best.get(key)
                            if had is None or row[i] < had[0]:
                                best[key] = (float(row[i]), [int(other[i])])
                            elif row[i] == had[0]:
                                had[1].append(int(other[i]))
            rows = [(int(ids[y]), g, d, i) for (y, g), (d, all_) in best.items() for i in all_]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["id", "grp", "d", "known_id"])


def nearest_of_groups(queries: DataFrame, known: DataFrame, most: float) -> DataFrame:
    """id, grp, d, known_id: for each query (id, v) and group of the known vectors (known_id, grp, v) those at the least mean absolute
    difference, if it is ``most`` or less; all of them in a tie. The query's own id doesn't count, nor do vectors of
    another length. Ids and groups are whole numbers."""
    asked = staged(queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL"))
    held = known.select(F.col("known_id").cast("long").alias("known_id"), F.col("grp").cast("long").alias("grp"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL AND grp IS NOT NULL")
    found = held.mapInArrow(partial(_distances, path=asked.staged_path, most=most), "id long, grp long, d double, known_id long")
    return found.withColumn("_r", F.rank().over(Window.partitionBy("id", "grp").orderBy("d"))).filter("_r = 1").drop("_r")
