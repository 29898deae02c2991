"""Periodic stretches of words in documents: found by grammar (see :mod:`factloom.llm.grammar`), listed, and collapsed to
their first period.

Each document is a row of its own, so nothing is shuffled; the documents of one Arrow batch share one grammar.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import grammar
from factloom.llm.shared import packed, text_batches

#: Given the id and the number of words of a document, the places its words are taken from.
Places = Callable[[int | None, int], np.ndarray]
_RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Words of documents that share a grammar; a document with more has one of its own.
BATCH_WORDS = 1 << 20


def repeated_tails(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of one document in ten (by the CRC-32 of its id, null as the empty string): from some word on a stretch is repeated to the end. None: as it is."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def _scanned(batches: Iterator[pa.RecordBatch], places: Places | None) -> Iterator[pa.RecordBatch]:
    """The last two columns, id and text (bytes), give way to n_words, runs and collapsed."""
    for batch in batches:
        ids, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
        counts, found, collapsed = [], [], []
        group: list[tuple[list[bytes], np.ndarray]] = []
        held = 0

        def close() -> None:
            counts.extend(len(words) for words, _ in group)
            number, size = _Ids(), sum(len(words) for words, _ in group) + 1
            # a word of another document is another word
            coded = [np.fromiter((number[w] for w in words), np.int64, len(words))[at] + size * k for k, (words, at) in enumerate(group)]
            begins = np.cumsum([0, *map(len, coded)])
            rows = grammar.runs(np.unique(np.concatenate(coded), return_inverse=True)[1])
            cuts = np.searchsorted(rows[:, 0], begins)
            for k, (words, at) in enumerate(group):
                mine = rows[cuts[k] : cuts[k + 1]] - np.array([begins[k], 0, 0])
                found.append([{"start": s, "length": n, "period": p} for s, n, p in mine.tolist()])
                left = at[kept_words(len(words), mine)] if len(mine) else at
                collapsed.append(b" ".join([words[i] for i in left.tolist()]))
            group.clear()

        for doc_id, text in zip(ids, texts):
            words = (text.as_py() or b"").split()
            if group and held + len(words) > BATCH_WORDS:
                close()
                held = 0
            at = places(doc_id, len(words)) if places else None
            group.append((words, np.arange(len(words)) if at is None else at))
            held += len(words)
        if group:
            close()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(counts, pa.int64()), pa.array(found, _ARROW_RUNS), pa.array(collapsed, pa.binary())], names=[*batch.schema.names[:-2], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, places: Places | None = None, carried: list[str] | None = None) -> DataFrame:
    """row (a struct of the ``carried`` columns of ``docs``, by default all), n_words, runs and collapsed of every row of
    ``docs`` (doc_id, text and any others).

    runs has start (word number), length and period of each longest stretch with that smallest period, of four periods and
    six words or more, by start and period. collapsed has the words that no run contains after its first period, joined by
    a blank. ``places`` may deal a document's words anew before that. A null or empty text has no words, no runs and collapses
    to nothing. Repeated rows are each looked at. An empty table gives none.
    """
    text_batches(docs.sparkSession)
    row = packed(docs.select(*[f"`{c}`" for c in carried]) if carried else docs)
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"))
    schema = T.StructType([rows.schema["row"]]).add("n_words", "long").add("runs", _RUNS).add("collapsed", "binary")
    return rows.mapInArrow(partial(_scanned, places=places), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run (ties: smallest start, then period) and digests of the runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("neg"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period, F.lit("\n"))), "")
    out = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.regexp_replace(lines, ",\n", "\n").alias("lines"), "collapsed")
    length, period = -F.col("best.neg"), F.col("best.period")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
