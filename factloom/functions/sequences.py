"""Pandas UDFs over pairs of sequences, where no built-in expression exists."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ints(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names])


def align(a: list, b: list, gap: int = 1, change: int = 1, swap: int = 1) -> tuple[int, int]:
    """Least cost of turning ``a`` into ``b`` by insertions, deletions and changes, and in how many ways it is reached
    (saturating); a change between members of equal length in text costs ``swap``. One anti-diagonal of the table at a time."""
    names: dict = {}
    x, y = (np.array([names.setdefault(t, len(names)) for t in s], np.int64) for s in (a, b))
    lx, ly = (np.array([len(str(t)) for t in s], np.int64) for s in (a, b))
    n, m, far = len(a), len(b), np.int64(1 << 40)
    none = np.full(n + 2, far)
    before, last = (none.copy(), np.zeros(n + 2, np.int64)), (none.copy(), np.zeros(n + 2, np.int64))  # from place 1 on
    last[0][1], last[1][1] = 0, 1
    for k in range(1, n + m + 1):
        i = np.arange(max(0, k - m), min(n, k) + 1)
        j = k - i
        both = (i > 0) & (j > 0)
        at, to = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        step = np.full(len(i), far)
        if n and m:
            step[both] = np.where(x[at] == y[to], 0, np.where(lx[at] == ly[to], swap, change))[both]
        # from one member less of both, of a, and of b
        costs = np.stack([before[0][i] + step, np.where(i > 0, last[0][i] + gap, far), np.where(j > 0, last[0][i + 1] + gap, far)])
        ways = np.stack([before[1][i], last[1][i], last[1][i + 1]])
        best = costs.min(0)
        now = (none.copy(), np.zeros(n + 2, np.int64))
        now[0][i + 1], now[1][i + 1] = best, np.minimum(1 << 30, np.where(costs == best, ways, 0).sum(0))
        before, last = last, now
    return int(last[0][n + 1]), int(last[1][n + 1])


@F.pandas_udf(_ints("cost", "ways"))
def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Global alignment of two arrays; a null array counts as empty."""
    found = [align([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["cost", "ways"])


@F.pandas_udf(T.StringType())
def renamed_apart(tokens: pd.Series) -> pd.Series:
    """Tokens joined by spaces with every name ($ and letters) renamed in order of first use, so that two sequences that
    differ by names alone become equal."""

    def one(row):
        names: dict[str, str] = {}
        return " ".join(names.setdefault(t, f"r{len(names)}") if t.startswith("$") else t for t in row)

    return tokens.map(lambda row: None if row is None else one(row))


@F.pandas_udf(T.BinaryType())
def packed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else zlib.compress(t.encode()))


@F.pandas_udf(T.StringType())
def unpacked(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else zlib.decompress(d).decode())
