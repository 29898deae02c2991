"""Score documents with a recurrent language model that is trained on the corpus itself.

Counts come from all training documents. The model's vocabulary is their most common words; all others form one token,
TAIL, whose words share its probability by their counts, so that every text has a proper probability. The model is
trained by all partitions at once: each trains its own copy on its documents, and the copies are averaged, in rounds.
Counts of common words are sent to the workers, within a fixed bound; those of all other words are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import gru
from factloom.llm.shared import stage, text_batches, unstage


@dataclass(frozen=True)
class Settings:
    #: Words whose counts are sent to the workers, at most; the rest are joined.
    common_words: int = 300_000
    #: Tokens of the model with END and TAIL, a multiple of its classes.
    vocabulary: int = 4096
    rounds: int = 2
    train_lanes: int = 256
    train_steps: int = 16
    rate: float = 0.02
    score_lanes: int = 512
    score_steps: int = 32
    #: How many times the steps a window may have where a few long documents are left: in training and in scoring.
    train_stretch: int = 8
    score_stretch: int = 64


#: Distinct words that a partition holds before it passes them on, and parts in which parameters are averaged.
_COUNTED, _PARTS, _SALTS = 500_000, 16, 64


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training, by its id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def split(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """Distinct words of a batch, all its words by their numbers, and where each text's begin and end: of bytes, only A-Z become small
    and only ASCII white space parts words. A null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found = lists.flatten().dictionary_encode()
    words, codes = found.dictionary.cast(pa.binary()), found.indices.to_numpy()
    bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64))
    # white space at either end of a text leaves an empty word there
    empty = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:
        kept = codes != empty
        codes, bounds = codes[kept], np.append(0, np.cumsum(kept))[bounds]
    return words, codes, bounds


def _looked_up(numbers: dict[bytes, int], words: pa.BinaryArray, other: int) -> np.ndarray:
    return np.fromiter(map(numbers.get, words.to_numpy(zero_copy_only=False), repeat(other)), np.int32, len(words))


def _ended(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The ids of each text, with END behind them."""
    stops = bounds[1:] + np.arange(1, len(bounds))
    laid = np.full(len(ids) + len(stops), gru.END, np.int32)
    inner = np.ones(len(laid), bool)
    inner[stops - 1] = False
    laid[inner] = ids
    return np.split(laid, stops[:-1])


def counted(texts: Iterator[pa.StringArray], most: int) -> Iterator[pa.RecordBatch]:
    """word and n of all texts; once so many distinct words are held, they are passed on and counted anew."""
    held, rows = [], 0

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in texts:
        words, codes, _ = split(batch)
        n = np.bincount(codes, minlength=len(words))
        held.append(pa.table({"word": words, "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0)))
        rows += len(held[-1])
        if rows > 2 * most:
            held = [merged()]
            rows = len(held[0])
            if rows > most:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from merged().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted((batch.column(0) for batch in batches), _COUNTED)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_common(counts: DataFrame, most: int) -> pa.Table:
    """The most common words, at most so many, in order; of words with equal counts all or none, so that a count to filter by
    is enough and no task has to rank them."""
    found = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect()  # bounded by most
    least, taken = math.inf, 0
    for r in found:
        taken += r.words
        if taken > most:
            break
        least = r.n
    top = counts.filter(F.col("n") >= F.lit(least)).toArrow()
    return top.sort_by([("n", "descending"), ("word", "ascending")])


def _averaged(spark, docs: DataFrame, params: dict[str, np.ndarray], words: dict[bytes, int], s: Settings) -> dict[str, np.ndarray]:
    """Train on each partition of ``docs`` (text) from ``params`` and average, each partition by the tokens it read."""
    size = s.vocabulary
    sent = spark.sparkContext.broadcast((gru.flat(params), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start, vocab = sent.value
        p = start.copy()

        def each():
            for batch in batches:
                found, codes, bounds = split(batch.column(0))
                yield from zip(repeat(None), _ended(_looked_up(vocab, found, gru.TAIL)[codes], bounds))

        read = gru.train(p, size, each(), s.train_lanes, s.train_steps, s.rate, s.train_stretch)
        if read:
            parts = np.array_split(p.astype(np.float64) * read, _PARTS)
            salt = TaskContext.get().partitionId() % _SALTS
            yield _vectors([(k, salt, float(read), v) for k, v in enumerate(parts)])

    kind = "part int, salt int, weight double, v binary"

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = np.sum([np.frombuffer(r["v"], "<f8") for r in rows], axis=0)
        return pa.Table.from_batches([_vectors([(rows[0]["part"], 0, sum(r["weight"] for r in rows), total)])])

    sums = docs.select("text").mapInArrow(run, kind).groupBy("part", "salt").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind)
    rows = sorted(sums.collect(), key=lambda r: r.part)  # one vector of parameters in all
    sent.unpersist()
    if not rows:
        return params
    return gru.unflat(np.concatenate([np.frombuffer(r.v, "<f8") / r.weight for r in rows]), size)


def _vectors(rows: list[tuple[int, int, float, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3].astype("<f8").tobytes() for r in rows], pa.binary())],
        names=["part", "salt", "weight", "v"],
    )


def score_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    A null or empty text is its end alone. Repeated rows are scored each for itself. Without any training document all
    counts are zero, and the model is the one it starts from. An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    counts = stage(word_counts(learn), "word-counts")
    ends = learn.count()
    total = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_all, distinct = total.n + ends, total.words + (ends > 0)
    top = _most_common(counts, s.common_words)
    common = dict(zip(top.column("word").to_pylist(), range(top.num_rows)))
    n = top.column("n").to_numpy().astype(np.float64)
    in_model = min(len(n), s.vocabulary - gru.FIRST_WORD)
    model_counts = np.zeros(s.vocabulary)
    model_counts[gru.END], model_counts[gru.TAIL] = ends, n_all - ends - n[:in_model].sum()
    model_counts[gru.FIRST_WORD : gru.FIRST_WORD + in_model] = n[:in_model]
    # the words of TAIL and, once more, all that training never saw
    tail_mass = model_counts[gru.TAIL] + 0.1 * (total.words - in_model) + 0.1
    params = gru.initial(model_counts)
    vocab = {w: i + gru.FIRST_WORD for w, i in list(common.items())[:in_model]}
    for k in range(s.rounds):
        share = learn.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(s.rounds)) == k)
        params = _averaged(spark, share, params, vocab, s)
    sent = spark.sparkContext.broadcast((gru.flat(params), common, np.log10(n + 0.1), ends))
    known_end = int(ends > 0)
    log_end, log_tail = math.log10(ends + 0.1), math.log10(tail_mass)
    log_all = math.log10(n_all + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flat, common, logs, _ = sent.value
        p = gru.unflat(flat, s.vocabulary)
        row, info = TaskContext.get().partitionId() << 33, {}

        def each():
            nonlocal row
            for batch in batches:
                found, codes, bounds = split(batch.column(1))
                at = _looked_up(common, found, -1)
                # of each distinct word, then of each document: its logarithm, of it what is in TAIL with a count that is here, and whether it is there
                known = at >= 0
                tail = ~known | (at >= in_model)
                log = np.where(known, logs[at], 0.0) if len(logs) else np.zeros(len(at))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                base, inside, n_known, n_tail = (np.bincount(doc, x[codes], batch.num_rows) for x in (log, np.where(tail, log, 0.0), known, tail))
                # words that the workers have no counts for, each once for a document
                at_rare = np.flatnonzero(~known[codes])
                pairs, times = np.unique(doc[at_rare] * max(1, len(found)) + codes[at_rare], return_counts=True)
                rare = found.take(pa.array(pairs % max(1, len(found)))).to_numpy(zero_copy_only=False).tolist()
                cuts = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * max(1, len(found))).tolist()
                sizes, times = np.diff(bounds).tolist(), times.tolist()
                ids = _ended(np.where(tail, gru.TAIL, at + gru.FIRST_WORD).astype(np.int32)[codes], bounds)
                for k, (doc_id, held) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                    own = slice(cuts[k], cuts[k + 1])
                    info[row] = (doc_id, held, sizes[k] + 1, int(n_known[k]) + known_end, float(base[k]) + log_end, float(inside[k]) - float(n_tail[k]) * log_tail, rare[own], times[own])
                    yield row, ids[k]
                    row += 1

        out = []
        for name, lp in gru.score(p, each(), s.score_lanes, s.score_steps, s.score_stretch):
            doc_id, held, tokens, known, base, inside, rare, times = info.pop(name)
            out.append((name, doc_id, held, tokens, known, base, lp + inside, rare, times))
            if len(out) >= 500:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    scored = docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double, rare array<binary>, rare_n array<long>")
    scored = stage(scored, "lm-scores")
    # what the workers have no counts for: one row for each such word of a document
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("times"))
    # words that were sent are never looked up here
    beyond = rare.join(counts, "word", "left").withColumn("log", F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.1) * F.col("times"))
    sums = beyond.groupBy("row").agg(F.sum("log").alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    out = scored.drop("rare", "rare_n").join(sums, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("lp") + log).alias("score"),
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("rare", pa.list_(pa.binary())), ("rare_n", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])
