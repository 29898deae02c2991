"""Remove repeated byte strings of a corpus by prefix-free parsing.

A rolling hash cuts every text into phrases. A place of the text is a trigger if its hash is zero modulo ``every``; a
stretch of ``reach`` places without a trigger is cut at its least hash, which bounds phrases on any text. Which phrase
start belongs to a place depends on the ``reach + ROLL - 1`` bytes behind it alone, so equal strings are parsed alike
wherever they occur.

1. Dictionary: a phrase is the run of places that belong to one start. It is named by the bytes behind the start that all
   strings of the run share (``suffix``: the parse suffix) and by all bytes of the run (``whole``). The names are counted,
   so that copies of a phrase go on as one row. Runs whose whole name occurs twice are repeated as they are.
2. Suffix order: what is left shares a parse suffix with another phrase but not the whole run. Phrases of one parse suffix
   are ranked by what follows (the parse's suffix array). From there the dictionary's suffixes are sorted one byte to the
   left at a time: a suffix stands where its first byte and the rank of the rest put it, and its common prefix with its
   neighbour follows from those of the round before. So dictionary and parse give the strings in corpus order, with the
   length that neighbours share; a string repeats if that is all of it.

Names are 64-bit hashes; of the 128 bits that name a run, 64 name its parse suffix. Within a parse suffix bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.shared import packed, stage, text_batches, unstage

#: Bytes of the rolling hash.
ROLL = 8
#: Places parsed at a time, and phrases of one parse suffix that are ordered in one task; more are ordered by shuffling.
_STEP, CROWD = 1 << 19, 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Strings:
    """What counts as a repeat: strings of ``length`` bytes (50 at least). Longer strings can be asked for at the same time;
    they are told apart by the length that neighbours share."""

    length: int = 400
    longer: tuple[int, ...] = ()

    @property
    def lengths(self) -> tuple[int, ...]:
        return (self.length, *self.longer)

    @property
    def reach(self) -> int:
        """Places among which a phrase start is looked for."""
        return min(160, 3 * self.length // 5)

    @property
    def every(self) -> int:
        """A place in so many is a trigger."""
        return 4 * self.reach // 5

    @property
    def shared(self) -> int:
        """Bytes behind a phrase start that all strings of its run share."""
        return self.length - self.reach + 1


def parse(raw: bytes, s: Strings = Strings()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First place, last place and phrase start of each run, a stretch of the text at a time. A place is one where a
    string of the length starts. A run is cut at the end of a stretch; that costs later work but loses nothing."""
    data = np.frombuffer(raw, np.uint8)
    places = len(data) - s.length + 1
    for at in range(0, places, _STEP):
        n = min(_STEP, places - at)
        part = data[at : at + n + s.reach + ROLL - 2]
        value = np.ascontiguousarray(sliding_window_view(part, ROLL)).view("<u8").ravel()
        value = (value ^ (value >> np.uint64(29))) * _MIX
        # triggers come before all others; the place in the lower half makes the first of equals the least
        high = (value >> np.uint64(32)).astype(np.uint32)
        high[high % np.uint32(s.every) == 0] = 0
        least = (high.astype(np.uint64) << np.uint64(32)) | np.arange(len(value), dtype=np.uint64)
        have = 1
        while have < s.reach:
            step = min(have, s.reach - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        start = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
        first = np.flatnonzero(np.diff(start, prepend=-1))
        last = np.append(first[1:], n) - 1
        yield first + at, last + at, start[first] + at


def text_key(raw: bytes) -> tuple[int, int]:
    """A text's MD5 as two longs."""
    a, b = np.frombuffer(hashlib.md5(raw).digest(), "<i8").tolist()
    return a, b


def phrases(docs: DataFrame, s: Strings = Strings()) -> DataFrame:
    """The runs of every text, with the text's key and the two names of each. ``place`` holds the phrase start, and from
    how many bytes before it to how many the run's strings start, in 48, 8 and 8 bits."""

    most = max(s.lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in batch.column(0):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < s.length:
                    continue
                k1, k2 = text_key(raw)
                for first, last, start in parse(raw, s):
                    a, b, c = first.tolist(), last.tolist(), start.tolist()
                    cols[0].append(np.full(len(a), k1))
                    cols[1].append(np.full(len(a), k2))
                    cols[2].append(start << 16 | (start - first) << 8 | (start - last))
                    cols[3].append(np.array([digest(raw[t : t + s.shared]) for t in c], "u8").view("i8"))
                    # the run's bytes and where the phrase starts in them
                    cols[4].append(np.array([digest(raw[i : j + most], t - i) for i, j, t in zip(a, b, c)], "u8").view("i8"))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["k1", "k2", "place", "suffix", "whole"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, place long, suffix long, whole long")


def _ends(place: str = "place") -> list[Column]:
    """start, far and near of a packed place."""
    c = F.col(place)
    return [F.shiftright(c, 16).alias("start"), F.shiftright(c, 8).bitwiseAND(255).alias("far"), c.bitwiseAND(255).alias("near")]


_CONTEXT = "suffix long, k1 long, k2 long, place long, left_bytes binary, right_bytes binary"


def _contexts(docs: DataFrame, open_: DataFrame, s: Strings) -> DataFrame:
    """The bytes of each open phrase before its start and behind its shared part."""
    lists = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("suffix", "place")).alias("runs"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, k1, k2, runs in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for r in runs:
                    t, far = r["place"] >> 16, r["place"] >> 8 & 255
                    rows.append((r["suffix"], k1, k2, r["place"], raw[t - far : t], raw[t + s.shared : t + max(s.lengths)]))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["suffix", "k1", "k2", "place", "left_bytes", "right_bytes"])

    return _keyed_texts(docs, s).join(lists, ["k1", "k2"]).select("text", "k1", "k2", "runs").mapInArrow(run, _CONTEXT)


def _key_columns(text) -> list:
    """The two longs of :func:`text_key` in SQL: bytes of the MD5 from the last to the first of each half."""
    digest = F.md5(text)
    halves = []
    for k in (0, 16):
        swapped = F.concat(*[F.substring(digest, k + 15 - 2 * i, 2) for i in range(8)])
        # 16 hexadecimal digits pass a long's range, so each half of them is taken by itself
        high, low = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long"), F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
        halves.append(F.shiftleft(high, 32).bitwiseOR(low))
    return [halves[0].alias("k1"), halves[1].alias("k2")]


def _keyed_texts(docs: DataFrame, s: Strings) -> DataFrame:
    """One row for each distinct text of at least the length with its key."""
    long = docs.select("text").filter(F.octet_length("text") >= s.length)
    return long.select("text", *_key_columns(F.col("text"))).dropDuplicates(["k1", "k2"])


def _order(batches: Iterator[pa.RecordBatch], s: Strings) -> Iterator[pa.RecordBatch]:
    """Sorted by parse suffix: the places of each phrase whose string equals another phrase's of the same suffix."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        suffix = held.column("suffix").to_numpy()
        cut = int(np.searchsorted(suffix, suffix[-1], side="left")) if len(suffix) else 0
        if cut >= 8192:
            yield from _neighbours(held.slice(0, cut), s)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _neighbours(held, s)


def _least_between(common: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each pair of places first < last of an order the bytes that the two share; ``common`` has those of each place
    with the one before."""
    if not len(first):
        return np.empty(0, common.dtype)
    pairs = np.column_stack([first + 1, last + 1]).ravel()
    return np.minimum.reduceat(np.append(common, 0), pairs)[::2]


def _neighbours(table: pa.Table, s: Strings) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    suffix, place = table.column("suffix").to_numpy(), table.column("place").to_numpy()
    start, far, near = place >> 16, place >> 8 & 255, place & 255
    group = np.cumsum(np.diff(suffix, prepend=suffix[:1]) != 0)
    width = max(s.lengths) - s.shared
    left, right, rights = np.zeros((n, s.reach), np.uint8), np.zeros((n, width), np.uint8), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(table.column("left_bytes").to_pylist(), table.column("right_bytes").to_pylist())):
        left[i, : len(a)] = np.frombuffer(a, np.uint8)[::-1]
        right[i, : len(b)] = np.frombuffer(b, np.uint8)
        rights[i] = len(b)
    # ranks of the parse suffixes' ends: what follows the shared part, within each group
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), right], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{8 + width}").ravel(), kind="stable")
    differ = right[order[1:]] != right[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(rights[order[1:]], rights[order[:-1]]))
    # shared bytes with the one before; below zero where nothing can be shared any more
    common = np.concatenate([[-1], np.where(group[order[1:]] == group[order[:-1]], common, -1)])
    found = {length: np.zeros((n, s.reach + 1), bool) for length in s.lengths}
    for d in range(s.reach):
        # strings that start d bytes before a phrase start
        own = np.flatnonzero((near[order] <= d) & (d <= far[order]))
        both = _least_between(common, own[:-1], own[1:])
        for length, at in found.items():
            whole = both >= length - s.shared
            at[order[own[1:][whole]], d] = True
            at[order[own[:-1][whole]], d] = True
        # one byte to the left: by group and byte, equals in the order they have
        on = np.flatnonzero(far[order] > d)
        key = group[order[on]] << 8 | left[order[on], d]
        to = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[to[1:]] == key[to[:-1]]) + 1
        after = np.full(len(on), -1)
        least = _least_between(common, on[to[same - 1]], on[to[same]])
        after[same] = np.where(least < 0, -1, least + 1)
        # a suffix that shares nothing with either neighbour never will
        stays = (after >= 0) | (np.append(after[1:], -1) >= 0)
        order, common = order[on[to[stays]]], after[stays]
        if not len(order):
            break
    k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
    for length, at in found.items():
        edge = np.diff(at.astype(np.int8), axis=1, prepend=0)
        row, begin = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        if len(row):
            arrays = [k1[row], k2[row], start[row] - stop + 1, start[row] - begin, np.full(len(row), length)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["k1", "k2", "first", "last", "length"])


_SPANS = "k1 long, k2 long, first long, last long, length long"


def repeated_places(docs: DataFrame, s: Strings = Strings()) -> DataFrame:
    """k1, k2, first, last, length: runs of places, for each distinct text, at which a string of a length starts that also
    starts elsewhere. A run may go on beyond the last place of the text where a longer string has room."""
    found = stage(phrases(docs, s), "phrases")
    # copies of a phrase are counted before anything meets by parse suffix
    names = stage(found.groupBy("suffix", "whole").agg(F.count("*").alias("n")), "phrase-names")
    # a parse suffix that occurs once belongs to no repeated string; staged, so that the join can divide a common one
    per = stage(names.groupBy("suffix").agg(F.count("*").alias("names"), F.sum("n").alias("all")).filter("all > 1").drop("all"), "suffix-names")
    shared = stage(names.join(per, "suffix"), "shared-names")
    unstage(names)
    unstage(per)
    some = stage(found.join(shared, ["suffix", "whole"]), "repeated-phrases")
    unstage(found)
    unstage(shared)
    at = F.shiftright("place", 16)
    spans = ["k1", "k2", (at - F.shiftright("place", 8).bitwiseAND(255)).alias("first"), (at - F.col("place").bitwiseAND(255)).alias("last")]
    each = F.explode(F.array(*[F.lit(n).cast("long") for n in s.lengths])).alias("length")
    alike = some.filter("n > 1").select(*spans).distinct().select("*", each)
    # suffixes with more than one whole name; one phrase of each name takes part
    one = some.filter("names > 1").groupBy("suffix", "whole").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("place").alias("place"), F.first("names").alias("names"))
    open_ = stage(one, "open-phrases")
    context = stage(_contexts(docs, open_, s), "phrase-contexts")
    # few rows; staged, as the table that it is taken from goes
    crowded = stage(open_.filter(F.col("names") > CROWD).select("suffix").distinct(), "crowded-suffixes")
    unstage(open_)
    few = context.join(crowded, "suffix", "left_anti")
    near = few.repartition("suffix").sortWithinPartitions("suffix").mapInArrow(partial(_order, s=s), _SPANS)
    # crowded suffixes: each string is a row of its own, keyed by all that tells it apart
    rows = context.join(crowded, "suffix", "left_semi").select("*", *_ends())
    rows = rows.withColumn("d", F.explode(F.sequence("near", "far")))
    rows = rows.withColumn("length", F.explode(F.array(*[F.lit(n).cast("long") for n in s.lengths])))
    behind = F.col("length") - s.shared - F.col("d")
    rows = rows.withColumn("behind", behind).filter("octet_length(right_bytes) >= behind")
    rows = rows.withColumn("string", F.md5(F.concat(F.expr("substring(left_bytes, CAST(octet_length(left_bytes) - d + 1 AS INT), CAST(d AS INT))"), F.expr("substring(right_bytes, 1, CAST(behind AS INT))"))))
    equal = rows.groupBy("suffix", "d", "length", "string").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    place = (F.col("start") - F.col("d")).alias("first")
    many = rows.join(equal, ["suffix", "d", "length", "string"]).select("k1", "k2", place, place.alias("last"), "length")
    out = stage(alike.unionByName(near).unionByName(many), "repeated-places")
    for done in (some, context, crowded):
        unstage(done)
    return out


def cut_spans(raw: bytes, runs: list[dict] | None, length: int, least_words: int = 0) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that the strings of a length starting in ``runs`` cover, those of at least so many words."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], min(r["last"], len(raw) - length)) for r in runs or [] if r["length"] == length):
        if first > last:
            continue
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out if not least_words or len(raw[a:b].split()) >= least_words]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What stays of a text; a character of which a byte is in a span goes wholly."""
    kept, done = [], 0
    for a, b in spans:
        while a > done and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        kept.append(raw[done:a])
        done = max(done, b)
    kept.append(raw[done:])
    return b"".join(kept)


def _with_runs(docs: DataFrame, s: Strings) -> DataFrame:
    """row (a struct of the columns of ``docs``), text, runs: every row of ``docs`` with the runs of its text, null where
    nothing is repeated."""
    text_batches(docs.sparkSession)
    runs = repeated_places(docs, s).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "length")).alias("runs"))  # of one text
    keyed = docs.select(packed(docs), "text").select("row", "text", *_key_columns(F.coalesce("text", F.lit(""))))
    return keyed.join(runs, ["k1", "k2"], "left").select("row", "text", "runs")


def removals(docs: DataFrame, length: int = 400, passages: int | None = None, least_words: int = 50, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same text or another; what
    is equal is judged on the input. So texts of that length that occur twice go wholly. A null text is empty. Rows with
    equal or null ids stay apart. An empty table gives none. Other columns are not read.

    With ``passages``, a smaller length, there are ``text`` too (unless ``texts`` is false): each text as :func:`without_repeats`
    leaves it for strings of that length and stretches of ``least_words`` words, null texts stay null; and n_passages and
    n_passage_bytes: how many such stretches the text has, and their bytes.
    """
    texts = texts and passages is not None
    s = Strings(length) if passages is None else Strings(passages, (length,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept_texts, stretches = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans = cut_spans(raw, runs, length)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
                if passages is not None:
                    found = cut_spans(raw, runs, passages, least_words)
                    stretches.append((len(found), sum(b - a for a, b in found)))
                    if texts:
                        kept_texts.append(_without(raw, found).decode("utf-8") if text.is_valid else None)
            n, gone, spans, digest = zip(*rows) if rows else ([], [], [], [])
            cols = {"doc_id": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if texts:
                cols["text"] = pa.array(kept_texts, pa.string())
            if passages is not None:
                for k, name in enumerate(("n_passages", "n_passage_bytes")):
                    cols[name] = pa.array([x[k] for x in stretches], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    rows = _with_runs(docs.select("doc_id", "text"), s).select("row.doc_id", "text", "runs")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts + ", n_passages long, n_passage_bytes long" * (passages is not None))


def without_repeats(docs: DataFrame, s: Strings = Strings(), least_words: int = 0) -> DataFrame:
    """row, n_removed: each row of ``docs`` as a struct, its text cut to the bytes that stay, and how many went.

    Cuts fall between characters: a character of which a byte is covered goes wholly. Stretches of fewer than
    ``least_words`` words stay. Null texts stay null. An empty table gives none.
    """
    inside = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                if not text.is_valid or not runs:
                    texts.append(text.as_py())
                    gone.append(0)
                    continue
                raw = text.as_buffer().to_pybytes()
                kept = _without(raw, cut_spans(raw, runs, s.length, least_words))
                texts.append(kept.decode("utf-8"))
                gone.append(len(raw) - len(kept))
            row = batch.column(0)
            fields = [pa.array(texts, pa.string()) if i == inside else row.field(i) for i in range(row.type.num_fields)]
            packed_again = pa.StructArray.from_arrays(fields, names=[row.type.field(i).name for i in range(row.type.num_fields)])
            yield pa.RecordBatch.from_arrays([packed_again, pa.array(gone, pa.int64())], names=["row", "n_removed"])

    return _with_runs(docs, s).mapInArrow(run, T.StructType().add("row", docs.schema).add("n_removed", T.LongType()))
