"""Token ids in files, compressed by a static range asymmetric numeral system.

One table of frequencies serves all blocks. A block holds whole documents in order; its ids are dealt over lanes in
turn, each lane a coder state of its own, so that numpy codes one id of every lane at a time. The states are kept
every so many rows (checkpoints), so a block can be decoded from any of them, and each block carries checksums of its
bytes and of its ids. Blocks are rows of a Parquet table, so every store that Spark reads can hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bits of a frequency table's total, of a state's renormalisation word, and lanes of a full block.
TABLE_BITS, WORD_BITS, LANES = 20, 32, 2048
#: Ids of a block before it is closed, and rows of lanes between two checkpoints.
BLOCK_IDS, CHECKPOINT_ROWS = 1 << 20, 128


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**TABLE_BITS; every id of the vocabulary has one of at least 1."""

    freq: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "start", np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64))
        object.__setattr__(self, "slot", np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64)))
        object.__setattr__(self, "wide", self.freq.astype(np.uint64))


def quantise(counts: np.ndarray) -> Table:
    """Scale counts to the table's total. What rounding leaves over or short goes to the largest frequencies."""
    total, size = 1 << TABLE_BITS, len(counts)
    if size > total // 2:
        raise ValueError(f"a vocabulary of {size} does not fit a table of {total}")
    share = counts.astype(np.float64) + 1e-9
    freq = np.maximum(1, np.floor(share * ((total - size) / share.sum()))).astype(np.int64)
    short = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while short:
        room = order if short > 0 else order[freq[order] > 1]
        step = room[: min(abs(short), len(room))]
        freq[step] += 1 if short > 0 else -1
        short = total - int(freq.sum())
    return Table(freq)


def encode_block(ids: np.ndarray, table: Table) -> tuple[int, bytes, bytes]:
    """Lanes, payload and checkpoints of a block of ids."""
    lanes = int(max(1, min(LANES, len(ids) // 64)))
    rows = -(-len(ids) // lanes)
    freq, start = table.wide, table.start
    state = np.full(lanes, 1 << WORD_BITS, np.uint64)
    limit = np.uint64(64 - TABLE_BITS)
    words, marks, written = [], [], 0
    for row in range(rows - 1, -1, -1):
        part = ids[row * lanes : (row + 1) * lanes]
        x = state[: len(part)]
        f = freq[part]
        full = x >= (f << limit)
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1]
            words.append(out)
            written += len(out)
            x = np.where(full, x >> np.uint64(WORD_BITS), x)
        q = x // f
        state[: len(part)] = (q << np.uint64(TABLE_BITS)) + (x - q * f) + start[part]
        if row % CHECKPOINT_ROWS == 0:
            marks.append((written, state.copy()))
    payload = np.concatenate(words)[::-1].tobytes() if words else b""
    # a checkpoint is the place in the payload, counted from its start, and the states before that row
    parts = []
    for at, states in reversed(marks):
        parts.append(np.array([written - at], "<u8").tobytes() + states.astype("<u8").tobytes())
    return lanes, payload, b"".join(parts)


def decode_block(n: int, lanes: int, payload: bytes, checkpoints: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block, or of the checkpoints from ``first`` up to ``last`` only."""
    rows, size = -(-n // lanes), 8 * (lanes + 1)
    marks = -(-rows // CHECKPOINT_ROWS)
    last = marks if last is None else min(last, marks)
    if first >= last:
        return np.empty(0, np.uint32)
    mark = np.frombuffer(checkpoints, "<u8", lanes + 1, first * size)
    at, state = int(mark[0]), mark[1:].astype(np.uint64)
    words = np.frombuffer(payload, "<u4")
    out = np.empty(min(n, last * CHECKPOINT_ROWS * lanes) - first * CHECKPOINT_ROWS * lanes, np.uint32)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    freq, start, slot = table.wide, table.start, table.slot
    done = 0
    while done < len(out):
        k = min(lanes, len(out) - done)
        x = state[:k]
        low = x & mask
        found = slot[low]
        out[done : done + k] = found
        x = freq[found] * (x >> np.uint64(TABLE_BITS)) + low - start[found]
        empty = np.flatnonzero(x < np.uint64(1 << WORD_BITS))
        if len(empty):
            x[empty] = (x[empty] << np.uint64(WORD_BITS)) | words[at : at + len(empty)].astype(np.uint64)
            at += len(empty)
        state[:k] = x
        done += k
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Blocks:
    """Collects documents and gives a block whenever one is full."""

    def __init__(self, table: Table):
        self.table, self.held, self.ids, self.next = table, [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        self.held.append((doc_id, ids))
        self.ids += len(ids)
        if self.ids >= BLOCK_IDS:
            yield self.close()

    def close(self) -> dict:
        ids = np.concatenate([x for _, x in self.held])
        lanes, payload, marks = encode_block(ids, self.table)
        block = {
            "block": self.next, "doc_ids": [d for d, _ in self.held], "lengths": [len(x) for _, x in self.held], "n_ids": len(ids), "lanes": lanes,
            "payload": payload, "checkpoints": marks, "bytes_crc32": zlib.crc32(marks, zlib.crc32(payload)), "ids_crc32": checksum(ids),
        }
        self.next += 1
        self.held, self.ids = [], 0
        return block


def read_block(block: dict, table: Table) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a block; a block whose checksums don't match is refused."""
    if zlib.crc32(block["checkpoints"], zlib.crc32(block["payload"])) != block["bytes_crc32"]:
        raise ValueError(f"block {block['block']}: its bytes are damaged")
    ids = decode_block(block["n_ids"], block["lanes"], block["payload"], block["checkpoints"], table)
    if checksum(ids) != block["ids_crc32"]:
        raise ValueError(f"block {block['block']}: its ids don't match their checksum")
    return list(zip(block["doc_ids"], np.split(ids, np.cumsum(block["lengths"])[:-1])))
