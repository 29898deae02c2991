"""Write the token ids of documents to files in id order, and read them back.

The tokens come from the tokenizers library. A word's ids don't depend on the words around it, so each worker asks the
library for every word that it hasn't met lately, for letters without their case and without what stands behind them.
Words of a batch are cut, told apart and put together again by Arrow, so that Python sees each distinct stem only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import rans
from factloom.llm.bpe import Encoder, byte_symbols
from factloom.llm.shared import new_path, stage, text_batches, unstage

#: Stems and other words that are remembered in each of two generations, and the longest such word.
MEMO_WORDS, MEMO_CHARS = 300_000, 48
BLOCK_SCHEMA = (
    "part int, block int, before long, doc_ids array<long>, lengths array<int>, n_ids long, lanes int, payload binary, checkpoints binary, bytes_crc32 long, ids_crc32 long"
)
_tokenizers: dict[str, LibraryWords] = {}


class LibraryWords:
    """Ids of words as the library has them, as little-endian bytes: 2 for each id if the vocabulary allows, else 4. Remembers
    stems and other words that it met lately."""

    def __init__(self, path: str, least_size: int = 0):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = max(self.library.get_vocab_size(with_added_tokens=True), least_size)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.stems, self.others = Lately(self.stem), Lately(lambda word: self.pack(self.one(word)))
        self.symbols = byte_symbols()
        self.packed = [i.to_bytes(int(self.kind[-1]), "little") for i in range(self.size)]

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def one(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def stem(self, stem: str) -> bytes | None:
        """Ids of letters alone: one piece, so the library's model has them without its text pipeline. None for all else."""
        if not stem:
            return b""
        plain = stem.isascii()
        if not stem.isalpha() or not (plain or Encoder.stays_letters(stem)):
            return None
        low = stem.lower()
        piece = low if plain else "".join(map(self.symbols.__getitem__, low.encode()))
        return b"".join([self.packed[t.id] for t in self.library.model.tokenize(piece)])

    def distinct(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of words that hold no ASCII white space, of each. Letters, with a run of ASCII punctuation behind them at most,
        are two pieces, so words that differ in case and in the run share the ids of the first."""
        trimmed = pc.ascii_rtrim(words, characters=punctuation)
        stems = pc.ascii_lower(trimmed).dictionary_encode()
        known = self.stems.all(stems.dictionary)
        whole = np.fromiter((x is None for x in known), bool, len(known))
        stem_at, known = stems.indices.to_numpy(), [x or b"" for x in known]
        # a word's second part, behind its stem: a run of punctuation, or the whole word where the stem is more than letters
        bounds, sizes = _offsets(words), np.diff(_offsets(trimmed))
        tailed = np.flatnonzero(~whole[stem_at] & (np.diff(bounds) > sizes))
        tails = _slices(words, bounds[tailed] + sizes[tailed], bounds[tailed + 1]).dictionary_encode()
        odd = np.flatnonzero(whole[stem_at])
        second = [b"", *self.others.all(tails.dictionary), *self.others.all(words.take(pa.array(odd)))]
        parts = np.empty((len(words), 2), np.int32)
        parts[:, 0], parts[:, 1] = stem_at, len(known)
        parts[tailed, 1] += 1 + tails.indices.to_numpy()
        parts[odd, 1] += 1 + len(tails.dictionary) + np.arange(len(odd), dtype=np.int32)
        return _joined(pa.array([*known, *second], pa.binary()).take(pa.array(parts.ravel())), np.arange(0, 2 * len(words) + 1, 2))

    def encode_array(self, texts: pa.StringArray, end: bytes = b"") -> pa.BinaryArray:
        """Ids of each text, with ``end`` behind them; a null is empty."""
        # a session may have texts with offsets of 64 bits; batches are small
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = lists.flatten().dictionary_encode()
        ids = pa.concat_arrays([self.distinct(words.dictionary), pa.array([end], pa.binary())])
        # the words of all texts one behind the other, with one more for each text's end
        stops = np.cumsum(pc.list_value_length(lists).to_numpy() + 1, dtype=np.int64)
        order = np.full(len(words) + len(texts), len(ids) - 1, np.int32)
        inner = np.ones(len(order), bool)
        inner[stops - 1] = False
        order[inner] = words.indices.to_numpy()
        return _joined(ids.take(pa.array(order)), np.append(0, stops))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


class Lately(dict):
    """What ``make`` gives for words, remembered in two generations."""

    def __init__(self, make: Callable[[str], bytes | None]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes | None:
        made = self.older[word] if word in self.older else self.make(word)
        if len(word) <= MEMO_CHARS:
            self[word] = made
        return made

    def all(self, words: pa.StringArray) -> list[bytes | None]:
        found = [self[w] for w in words.to_numpy(zero_copy_only=False)]
        if len(self) > MEMO_WORDS:
            self.older = dict(self)
            self.clear()
        return found


def _offsets(array: pa.StringArray | pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], "<i4")[array.offset : array.offset + len(array) + 1]


def _slices(array: pa.StringArray, begins: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """What lies between places of the array's bytes, in order; the stretches between them are laid out too and left."""
    if not len(begins):
        return pa.array([], pa.string())
    bounds = np.stack([begins, ends], axis=1).ravel()
    laid = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), array.buffers()[2]])
    return laid.take(pa.array(np.arange(0, len(laid), 2)))


def _joined(array: pa.BinaryArray, bounds: np.ndarray) -> pa.BinaryArray:
    """Values from each bound to the next as one; they lie one behind the other already."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(_offsets(array)[bounds]), array.buffers()[2] or pa.py_buffer(b"")])


def library_words(path: str, least_size: int = 0) -> LibraryWords:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = LibraryWords(path, least_size)
    return _tokenizers[path]


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and the little-endian ids of every document, with the end id; 2 bytes an id if the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(path, end_id + 1)
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), words.encode_array(batch.column(1), end)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def vocabulary_counts(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs, over all documents; the driver gets one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            # the ids of all rows at once, as they lie one behind the other
            ids = batch.column(0)
            ends = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1]
            if len(ids):
                counts += np.bincount(np.frombuffer(ids.buffers()[2].slice(ends[0], ends[-1] - ends[0]), kind), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for row in rows:
        counts[row.id] = row.n
    return counts


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int, partitions: int) -> None:
    """Tokenise ``docs`` (doc_id, text) and write blocks in ascending doc_id order under ``out``.

    Rows with a null id come first; equal ids follow each other in the order of their ids' bytes. A null text is empty
    and leaves the end id alone. ``out``/blocks has the blocks, ``out``/table the frequencies.
    """
    spark = docs.sparkSession
    text_batches(spark)
    words = library_words(path, end_id + 1)
    size, kind = words.size, words.kind
    tokens = stage(tokenized(docs, path, end_id), "token-ids")
    table = rans.quantise(vocabulary_counts(tokens, size, kind))
    spark.createDataFrame(list(enumerate(table.freq.tolist())), "id int, freq int").coalesce(1).write.parquet(f"{out}/table")
    freq = spark.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        blocks = rans.Blocks(rans.Table(freq.value))
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for block in blocks.add(doc_id, np.frombuffer(raw.as_buffer(), kind).astype(np.uint32)):
                    yield _row(part, before, block)
                    before += block["n_ids"]
        if blocks.held:
            yield _row(part, before, blocks.close())

    # the second key parts equal ids
    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{out}/blocks")
    freq.unpersist()
    unstage(tokens)


_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("lanes", pa.int32()),
    ("payload", pa.binary()), ("checkpoints", pa.binary()), ("bytes_crc32", pa.int64()), ("ids_crc32", pa.int64()),
])


def _row(part: int, before: int, block: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "before": before} | block], schema=_ARROW)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) and ids_crc32 of every document in the files."""
    from pyspark.sql import Window

    freq = spark.sparkContext.broadcast(np.array([r.freq for r in spark.read.parquet(f"{out}/table").orderBy("id").collect()], np.int64))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
    # each block knows the ids before it in its part; the sums of the parts are one row for each part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("parts_before"))
    located = blocks.join(F.broadcast(parts), "part").withColumn("first", (F.col("parts_before") + F.col("before")).cast("long")).drop("parts_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq.value)
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                docs = rans.read_block(block, table)
                lengths = np.array(block["lengths"], np.int64)
                starts = block["first"] + np.cumsum(lengths) - lengths
                raw = [x.astype("<u4").tobytes() for _, x in docs]
                sums = [rans.zlib.crc32(x) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(raw, pa.binary()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    return located.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_file_digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the files of ``docs`` to the shared folder, and return what they give back for each document."""
    spark = docs.sparkSession
    out = new_path(spark, "token-files")
    write_token_files(docs, path, out, end_id, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_token_files(spark, out).drop("ids")
