"""A Re-Pair grammar of word sequences, and the runs (periodic stretches) found in its nonterminals.

All in numpy, for one batch of documents at a time. A run crosses the boundary of exactly one node of the parse: the lowest
one that covers it. So each nonterminal's boundary is looked at once, in one place where it is derived, and what is found holds at all places.

Only stretches whose word triples each occur three times in their document are parsed: in a run of length four periods or
more every triple does, so no run is cut.
"""

from __future__ import annotations

import numpy as np

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_stretches(ids: np.ndarray, times: int = 3) -> list[tuple[int, int]]:
    """[i, j) of the longest stretches of ``LEAST_WORDS`` or more words all of whose triples occur ``times`` times or more."""
    if len(ids) < LEAST_WORDS:
        return []
    size = int(ids.max()) + 1
    _, pair, n = np.unique(ids[:-1] * size + ids[1:], return_inverse=True, return_counts=True)
    often = n[pair] >= times
    at = np.flatnonzero(often[:-1] & often[1:])
    if not len(at):
        return []
    _, triple, n = np.unique(pair[at] * size + ids[at + 2], return_inverse=True, return_counts=True)
    at = at[n[triple] >= times]
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
    keep = last - first + 3 >= LEAST_WORDS
    return list(zip(first[keep].tolist(), (last[keep] + 3).tolist()))


class Grammar:
    """Parse of a sequence ``w``, whose negative symbols each stand alone and are never paired.

    ``start``, ``mid`` and ``end`` of each nonterminal are a place where it is derived and the boundary of its two parts;
    ``places(nodes)`` has all of them. Pairs within a factor of two of the most frequent are replaced in the same round; where
    occurrences overlap, a mixed order of the pairs decides, and equal pairs go from left to right. What Re-Pair leaves is
    joined two by two into a balanced tree, each node of which occurs once.
    """

    def __init__(self, w: np.ndarray) -> None:
        self.w = w
        next_, self._nodes = int(w.max(initial=0)) + 1, []
        sym, start = w.copy(), np.arange(len(w))
        end = start + 1
        joined = (sym[:-1] >= 0) & (sym[1:] >= 0)  # with the one behind, if that may still become a pair
        done = []
        while True:
            # alone on both sides: part of the top sequence
            left, right = np.concatenate([[False], joined]), np.concatenate([joined, [False]])
            alone = ~left & ~right
            done.append((start[alone & (sym >= 0)], end[alone & (sym >= 0)]))
            sym, start, end, joined = sym[~alone], start[~alone], end[~alone], right[~alone][:-1]
            if not len(sym):
                break
            at = np.flatnonzero(joined)
            a, b = sym[at], sym[at + 1]
            # of equal symbols in a row only every other place counts
            same = a == b
            if same.any():
                fresh = np.concatenate([[True], ~same[:-1] | (np.diff(at) > 1) | (a[1:] != a[:-1])])
                where = np.arange(len(at))
                ok = ~same | ((where - np.maximum.accumulate(np.where(fresh, where, 0))) % 2 == 0)
            else:
                ok = np.ones(len(at), bool)
            code = a * next_ + b
            seen, pair, n = np.unique(code[ok], return_inverse=True, return_counts=True)
            top = int(n.max(initial=0))
            # a pair that occurs once never becomes more frequent
            once = np.zeros(len(at), bool)
            once[ok] = n[pair] < 2
            if same.any():
                # the skipped places of equal symbols stay open while their pair is frequent
                once[~ok] = ~np.isin(code[~ok], seen[n >= 2])
            if top >= 2:
                mixed = np.zeros(len(at), np.uint64)
                mixed[ok] = np.where(n >= (top + 1) // 2, (seen.astype(np.uint64) + np.uint64(1)) * _MIX, 0)[pair]
                rank = np.zeros(len(sym) + 1, np.uint64)
                rank[at + 1] = mixed
                now = rank[1:]
                before, after = rank[:-1], np.concatenate([rank[2:], np.zeros(1, np.uint64)])
                take = np.flatnonzero((now > 0) & (now > before) & (now > after))
                picked = sym[take] * next_ + sym[take + 1]
                names, which = np.unique(picked, return_inverse=True)
                self._nodes.append((which, start[take], end[take], end[take + 1], len(names)))
                joined[at[once]] = False
                sym[take], end[take] = next_ + which, end[take + 1]
                next_ += len(names)
                keep = np.ones(len(sym), bool)
                keep[take + 1] = False
                right = np.concatenate([joined, [False]])
                right[take] = right[take + 1]
                sym, start, end, joined = sym[keep], start[keep], end[keep], right[keep][:-1]
            else:
                joined[:] = False
        self.rounds = len(self._nodes)
        top_start, top_end = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(top_start)
        self._join(top_start[order], top_end[order])
        self._number()

    def _join(self, start: np.ndarray, end: np.ndarray) -> None:
        """Balanced trees over the top sequence, one for each stretch between symbols that stand alone."""
        while len(start) > 1:
            touch = end[:-1] == start[1:]
            first = np.concatenate([[True], ~touch])
            where = np.arange(len(start))
            place = where - np.maximum.accumulate(np.where(first, where, 0))
            take = np.flatnonzero((place[:-1] % 2 == 0) & touch)
            if not len(take):
                return
            self._nodes.append((np.arange(len(take)), start[take], end[take], end[take + 1], len(take)))
            keep = np.ones(len(start), bool)
            keep[take + 1] = False
            end = end.copy()
            end[take] = end[take + 1]
            start, end = start[keep], end[keep]

    def _number(self) -> None:
        base, names = 0, []
        for which, *_, n in self._nodes:
            names.append(which + base)
            base += n
        none = np.zeros(0, np.int64)
        name = np.concatenate([none, *names])
        start, mid, end = (np.concatenate([none, *[n[k] for n in self._nodes]]) for k in (1, 2, 3))
        order = np.argsort(name, kind="stable")
        self._starts, self._first = start[order], np.searchsorted(name[order], np.arange(base + 1))
        one = order[self._first[:-1]]
        self.start, self.mid, self.end = start[one], mid[one], end[one]

    def places(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place where one of ``nodes`` is derived: its position among ``nodes``, and where the place starts."""
        n = self._first[nodes + 1] - self._first[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        return of, self._starts[self._first[nodes][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]


def _common(w: np.ndarray, i: int, j: int, most: int) -> int:
    """Length of the longest common stretch of w[i:] and w[j:], ``most`` at most."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        differ = np.flatnonzero(w[i + n : i + n + step] != w[j + n : j + n + step])
        if len(differ):
            return n + int(differ[0])
        n += step
        step *= 4
    return n


def _heavy_left(w: np.ndarray, triples: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, i, j, period) of stretches with two periods or more to the left of a boundary and something to its right.

    Candidates for a period are the distances to earlier occurrences of the boundary's triple. Where a stretch of L words to
    the left is found, no other primitive period is at most L/2, so the search goes on beyond that.
    """
    total = len(w)
    back, found = w[::-1], []
    most = np.minimum((end - start) // LEAST_PERIODS, (mid - start) // 2)
    least = np.ones(len(start), np.int64)

    def check(k: int, q: int) -> None:
        s, b, e = int(start[k]), int(mid[k]), int(end[k])
        suffix = _common(back, total - b, total - b + q, b - q - s)
        if suffix < q:
            least[k] = q + 1
            return
        ahead = _common(w, b - q, b, e - b)
        if ahead and q + suffix + ahead >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.append((k, b - q - suffix, b + ahead, q))
        least[k] = max(q + 1, (q + suffix) // 2 + 1)

    for q in (1, 2):  # too short for a triple
        at = np.flatnonzero((most >= q) & (least <= q))
        for j in range(q):
            at = at[w[mid[at] - 1 - j] == w[mid[at] - 1 - q - j]]
        for k in at.tolist():
            check(k, q)
    least = np.maximum(least, 3)
    keys = np.sort(triples * total + np.arange(len(triples)))
    at = np.flatnonzero(most >= least)
    while len(at):
        here = mid[at] - 3
        name = triples[here]
        near = keys[np.maximum(np.searchsorted(keys, name * total + here - least[at], side="right") - 1, 0)]
        q = here - near % total
        ok = (near // total == name) & (q >= least[at]) & (q <= most[at])
        at, q = at[ok], q[ok]
        least[at] = q + 1
        likely = np.ones(len(at), bool)
        for j in (q - 1, q // 2, q // 3, 2 * q // 3, q // 5):
            likely &= w[mid[at] - 1 - j] == w[mid[at] - 1 - q - j]
        for k, x in zip(at[likely].tolist(), q[likely].tolist()):
            check(k, x)
        at = at[least[at] <= most[at]]
    return found


def _primitive(block: np.ndarray) -> bool:
    n = rest = len(block)
    p = 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = n // p
            if np.array_equal(block[d:], block[: n - d]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def boundary_runs(grammar: Grammar) -> tuple[np.ndarray, ...]:
    """node, i, j, period: the longest stretches within each nonterminal that cross its boundary, have ``LEAST_PERIODS``
    periods and ``LEAST_WORDS`` words or more, and no smaller period."""
    w, total = grammar.w, len(grammar.w)
    at = np.flatnonzero(grammar.end - grammar.start >= LEAST_WORDS)
    start, mid, end = grammar.start[at], grammar.mid[at], grammar.end[at]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    low = int(w.min())
    size = int(w.max()) - low + 1
    _, pair = np.unique((w[:-1] - low) * size + w[1:] - low, return_inverse=True)
    _, triples = np.unique(pair[:-1] * size + w[2:] - low, return_inverse=True)
    found = set(_heavy_left(w, triples, start, mid, end))
    # four periods: two of them to the left, or two to the right
    found |= {(k, total - j, total - i, q) for k, i, j, q in _heavy_left(w[::-1], triples[::-1], total - end, total - mid, total - start)}
    rows = sorted((k, i, j, q) for k, i, j, q in found if _primitive(w[i : i + q]))
    k, i, j, q = np.array(rows, np.int64).reshape(-1, 4).T
    return at[k], i, j, q


def runs(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of ``ids`` (non-negative; words of two documents have no id in common)."""
    stretches = repeated_stretches(ids)
    if not stretches:
        return np.zeros((0, 3), np.int64)
    _, named = np.unique(np.concatenate([ids[i:j] for i, j in stretches]), return_inverse=True)
    parts, places, n = [], [], 0
    for k, (i, j) in enumerate(stretches):
        parts += [named[n : n + j - i], np.array([-1 - k])]
        places.append(np.arange(i, j + 1))
        n += j - i
    grammar, place = Grammar(np.concatenate(parts).astype(np.int64)), np.concatenate(places)
    node, i, j, q = boundary_runs(grammar)
    of, at = grammar.places(node)
    start = place[at + i[of] - grammar.start[node][of]]
    return merged(start, (j - i)[of], q[of])


def merged(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Stretches of one period that share a period's length of words are parts of one; rows (start, length, period) of the whole ones."""
    if not len(start):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, period))
    start, length, period = start[order], length[order], period[order]
    end = start + length
    # periods one after another on one line, so that an earlier period ends before the next begins
    shift = (np.cumsum(np.concatenate([[0], np.diff(period) > 0]))) * (int(end.max()) + 1)
    upto = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > upto[:-1] - period[1:]]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    out = np.stack([start[first], upto[last] - shift[last] - start[first], period[first]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]
