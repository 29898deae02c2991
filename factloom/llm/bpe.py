"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text machine.

A merge list decides how far to the right a token boundary can still be disturbed. A merge of (a, b) differs
between a text and its prefix only if the token b, or something grown from a left part of b, was itself
disturbed by an earlier merge. The longest chain of such merges, each of a lower rank than the one to its left,
bounds the lookahead (:func:`sufficient_lookahead`). A long word is therefore cut into windows: a token is
emitted once that many symbols behind it have been read, and memory stays constant however long the word is.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factloom.llm.shared import text_batches

#: Characters of a text that are taken in one step.
SLICE = 1 << 18
#: Symbols of a word up to which it is merged in one window.
WINDOW = 1024
#: Words whose ids are remembered in each of two generations, and the longest such word.
MEMO_WORDS, MEMO_CHARS = 250_000, 48

#: The rank of pairs that no rule merges.
NEVER = 1 << 30

#: White space of the Unicode standard; fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_CHUNK = regex.compile(f"[^{WHITE}]+")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")  # str.split() takes these for white space, Unicode does not


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols to the right after which a token boundary is final.

    merges: (left, right, merged) by rank; length: symbols of each token.
    """
    left_child = {}
    born = {}
    for rank, (a, _, ab) in enumerate(merges):
        left_child.setdefault(ab, a)
        born.setdefault(ab, rank)
    ranks: dict[int, list[int]] = {}  # of the rules with this left operand
    reach: dict[int, list[int]] = {}  # the farthest of them up to each
    most = 1
    for rank, (a, b, _) in enumerate(merges):
        far, x = length[b], b
        while x is not None:
            if x in ranks and (k := bisect_left(ranks[x], rank)):
                far = max(far, reach[x][k - 1])
            x = left_child.get(x)
        far += length[a]
        ranks.setdefault(a, []).append(rank)
        reach.setdefault(a, []).append(max(far, reach[a][-1] if reach.get(a) else 0))
        most = max(most, far)
    return most


def cut(text: str) -> Iterator[str]:
    """Slices that end before white space, so that no word is cut."""
    start = 0
    while len(text) - start > SLICE:
        end = start + SLICE
        while end > start and text[end] not in WHITE:
            end -= 1
        if end == start:
            m = regex.compile(f"[{WHITE}]").search(text, start + SLICE)
            end = m.start() if m else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


class Encoder(dict):
    """Ids of each word as it stands between white space. As a mapping it remembers common words."""

    def __init__(self, path: str, window: int = WINDOW):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError(f"{path}: not a plain word-level BPE file")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._piece = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.pool = list(range(size))
        suffix, self.symbols = model["end_of_word_suffix"], byte_symbols()
        self.inner = [self.pool[vocab[self.symbols[b]]] for b in range(256)]
        self.last = [self.pool[vocab[self.symbols[b] + suffix]] for b in range(256)]
        rules, length = [], dict.fromkeys([*self.inner, *self.last], 1)
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            rules.append((x, y, z))
            length[z] = length[x] + length[y]
        self.rank = {(self.pool[x], self.pool[y]): i for i, (x, y, _) in reversed(list(enumerate(rules)))}
        self.merged = [self.pool[z] for _, _, z in rules]
        self.length = length
        self.rules = rules
        self.window = window
        self._lookahead: int | None = None
        self.older: dict[str, tuple[int, ...]] = {}
        self.surface = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.surface[i] = token
        self.number = [str(i) for i in range(size)]

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            self._lookahead = sufficient_lookahead(self.rules, self.length)
        return self._lookahead

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            stem = word[:-1] if word[-1] in ".," else word
            if stem.isalpha() and (stem.isascii() or self.stays_letters(stem)):
                ids = self._letters(stem)
                if stem is not word:
                    ids += (self.last[ord(word[-1])],)
            else:
                ids = tuple(self.word_ids(word))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def stays_letters(word: str) -> bool:
        return "Σ" not in word and unicodedata.is_normalized("NFC", word) and word.lower().isalpha()

    def _letters(self, word: str) -> tuple[int, ...]:
        """A word of letters only is one piece."""
        raw = word.lower().encode()
        if len(raw) > self.window:
            return tuple(self.stream(raw))
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return tuple(self.merge(ids))

    def word_ids(self, word: str) -> Iterator[int]:
        if self._special and "<|" in word and self._special.search(word):
            at = 0
            for m in self._special.finditer(word):
                yield from self._plain(word[at : m.start()])
                yield self.specials[m[0]]
                at = m.end()
            word = word[at:]
        yield from self._plain(word)

    def _plain(self, word: str) -> Iterator[int]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        # one character at a time: a final sigma has no form of its own here
        word = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)
        for m in self._piece.finditer(word):
            raw = m[0].encode("utf-8", "replace")
            if len(raw) <= self.window:
                ids = [self.inner[b] for b in raw]
                ids[-1] = self.last[raw[-1]]
                yield from self.merge(ids)
            else:
                yield from self.stream(raw)

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Ids of one long word from its bytes as they come, each as soon as nothing to its right can change it."""
        ahead, buffer, n = self.lookahead, [], 0
        most = 2 * (ahead + self.window)
        for b in symbols:
            buffer.append(b)
            n += 1
            if n < most:
                continue
            # the last byte may end the word, so it waits
            done = 0
            for token in self.merge([self.inner[x] for x in buffer[:-1]]):
                if done + self.length[token] > n - 1 - ahead:
                    break
                done += self.length[token]
                yield token
            del buffer[:done]
            n = len(buffer)
        if buffer:
            ids = [self.inner[b] for b in buffer]
            ids[-1] = self.last[buffer[-1]]
            yield from self.merge(ids)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge by lowest rank, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, merged = self.rank, self.merged
        pairs = [rank.get(p, NEVER) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NEVER:
            i, new = pairs.index(best), merged[best]
            ids[i : i + 2] = (new,)
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get((ids[i - 1], new), NEVER)
            if i < len(pairs):
                pairs[i] = rank.get((new, ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = self.merged[r], True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := rank.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [x for x, g in zip(ids, gone) if not g]

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a whole text, slice by slice."""
        for part in cut(text or ""):
            words = _CHUNK.findall(part) if any(c in part for c in _SEPARATORS) else part.split()
            yield list(chain.from_iterable(map(self.__getitem__, words)))


class Decoder:
    """Text of ids as they come: tokens are joined by one space, as a file without a decoder has it.

    With ``by_bytes`` each token is taken for its bytes instead, and the bytes pass through an incremental
    UTF-8 machine that keeps an unfinished character until its rest comes.
    """

    def __init__(self, encoder: Encoder, by_bytes: bool = False):
        self.surface, self.begun, self.bytes = encoder.surface, False, None
        if by_bytes:
            back = {s: b for b, s in encoder.symbols.items()}
            self.bytes = [bytes(back[c] for c in t.removesuffix("</w>") if c in back) + b" " * t.endswith("</w>") for t in self.surface]
            self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if self.bytes is not None:
            return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))
        if not ids:
            return ""
        text = " ".join(map(self.surface.__getitem__, ids))
        text, self.begun = " " + text if self.begun else text, True
        return text

    def finish(self) -> str:
        return self.machine.decode(b"", True) if self.bytes is not None else ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """Every row of ``docs`` with the ids of its whole text and, if asked for, the decoded text.

    A null or empty text has no ids and decodes to an empty text. Repeated rows stay. ``path`` is the vocabulary
    file, at the same place on every executor. Other columns pass through; one called as an output column is refused.
    """
    out = [ids_col] + ([decoded_col] if decoded_col else [])
    if clash := set(out) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    text_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = [], []
            for text in batch.column(at):
                found = list(chain.from_iterable(enc.encode(text.as_py())))
                ids.append(found)
                if decoded_col:
                    dec = Decoder(enc)
                    texts.append(dec.feed(found) + dec.finish())
            cols = [*batch.columns, pa.array(ids, pa.list_(pa.int32()))]
            if decoded_col:
                cols.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *out])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    if decoded_col:
        schema = schema.add(decoded_col, T.StringType())
    return docs.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """For each document the number of ids, and digests of the ids and of what they decode to.

    Ids are digested and decoded slice by slice, so a text of any length takes the memory of one slice.
    A null or empty text has no ids: both digests are of the empty string. Rows with equal or null doc_id stay apart.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        number = enc.number.__getitem__
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                n, ids_sum, text_sum, dec = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc)
                for ids in enc.encode(text):
                    if ids:
                        ids_sum.update(((" " if n else "") + " ".join(map(number, ids))).encode())
                        text_sum.update(dec.feed(ids).encode("utf-8", "replace"))
                        n += len(ids)
                text_sum.update(dec.finish().encode("utf-8", "replace"))
                counts.append(n)
                of_ids.append(ids_sum.hexdigest())
                of_text.append(text_sum.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
