"""A small gated recurrent language model in numpy, with a class-factored softmax.

A word's probability is that of its class times its own within the class. Classes are runs of the vocabulary in order of
frequency. Training is by truncated backpropagation: a window's gradient stops at its start, but the state that it
starts from is carried over from the window before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, CLASSES = 16, 64
#: Ids of the end of a document (also what a document starts from) and of all words outside the vocabulary.
END, TAIL, FIRST_WORD = 0, 1, 2
NAMES = ("E", "W", "U", "b", "Wc", "bc", "Wo", "bo")


def shapes(vocabulary: int) -> dict[str, tuple[int, ...]]:
    h = HIDDEN
    return {"E": (vocabulary, h), "W": (h, 3 * h), "U": (h, 3 * h), "b": (3 * h,), "Wc": (h, CLASSES), "bc": (CLASSES,), "Wo": (vocabulary, h), "bo": (vocabulary,)}


def initial(counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters that give each word its share of ``counts``; their number is a multiple of CLASSES."""
    rnd, p = np.random.default_rng(seed), {}
    for name, shape in shapes(len(counts)).items():
        scale = 0.0 if name in ("b", "Wc", "Wo") else (0.5 if name == "E" else 1 / np.sqrt(HIDDEN))
        p[name] = (rnd.standard_normal(shape) * scale).astype(np.float32)
    share = (counts + 0.1).reshape(CLASSES, -1)
    p["bc"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    p["bo"] = np.log(share / share.sum(1, keepdims=True)).ravel().astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in NAMES])


def unflat(v: np.ndarray, vocabulary: int) -> dict[str, np.ndarray]:
    """Parameters of a vector, as views of it if it is of 32 bits."""
    v, p, at = v.astype(np.float32, copy=False), {}, 0
    for name, shape in shapes(vocabulary).items():
        n = int(np.prod(shape))
        p[name] = v[at : at + n].reshape(shape)
        at += n
    return p


def inputs(p: dict[str, np.ndarray]) -> np.ndarray:
    """What each word adds to the gates z, r and c: (3, vocabulary, hidden), as ``run`` has it."""
    return _by_gate(p["E"] @ p["W"] + p["b"])


def _by_gate(x: np.ndarray) -> np.ndarray:
    """Gates one after another, in the way that exp takes: sigmoid(a) is 1 / (1 + exp(-a)), tanh(a) is 2 / (1 + exp(-2a)) - 1."""
    out = np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).swapaxes(0, 1))
    out[:2] *= -1
    out[2] *= -2
    return out


def _sigmoid(x: np.ndarray) -> None:
    """In place, of -x. exp may overflow; the quotient is zero then."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


_rooms: dict[tuple, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """An array for a task's own use until the name is asked for again; fresh memory for each window would cost more than
    what is done in it."""
    size = int(np.prod(shape))
    found = _rooms.get((name, kind))
    if found is None or len(found) < size:
        found = _rooms[name, kind] = np.empty(size, kind)
    return found[:size].reshape(shape)


def run(p: dict[str, np.ndarray], table: np.ndarray, x: np.ndarray, h: np.ndarray, pasts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States (steps + 1, lanes, hidden) before, between and after the steps x (steps, lanes) from h (lanes, hidden), and the
    gates z, r and c of each (3, steps, lanes, hidden). ``table`` is that of ``inputs``; ``pasts`` takes what r is put on."""
    U, kind = _by_gate(p["U"]), h.dtype
    gates = np.take(table, x, axis=1, out=_room("gates", (3, *x.shape, HIDDEN), table.dtype), mode="clip")
    states = _room("states", (len(x) + 1, *h.shape), kind)
    u = _room("u", (3, *h.shape), kind)
    states[0] = h
    with np.errstate(over="ignore"):
        for t in range(len(x)):
            h, new, zr, c = states[t], states[t + 1], gates[:2, t], gates[2, t]
            np.matmul(h, U, out=u)
            zr += u[:2]
            _sigmoid(zr)
            past = u[2]
            if pasts is not None:
                np.multiply(past, -0.5, out=pasts[t])
            past *= zr[1]
            c += past
            _sigmoid(c)
            c += c
            c -= 1
            np.subtract(h, c, out=new)
            new *= zr[0]
            new += c
    return states, gates


#: Logits of this size neither overflow in exp, nor when what comes of them meets the weights, nor vanish from sums, in 32 bits.
_SAFE = 78.0
#: Tokens that are scored at once, as their logits should stay in the cache.
_ROWS = 4096


def outputs(p: dict[str, np.ndarray], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, float]:
    """What makes logits of classes and of words from a state with a 1 behind it, and the largest logit of states within one."""
    to_class = np.concatenate([p["Wc"], p["bc"][None]]).astype(kind)
    to_word = np.concatenate([p["Wo"], p["bo"][:, None]], axis=1).astype(kind, copy=False)
    return to_class, to_word, max(np.abs(to_class).sum(0).max(), (np.abs(to_word) @ np.ones(HIDDEN + 1, kind)).max())


def log_probs(p: dict[str, np.ndarray], hs: np.ndarray, y: np.ndarray, grads: dict | None = None, out_of: tuple | None = None) -> np.ndarray:
    """Natural log-probability of each y after states hs. With ``grads``, adds the gradients of their negative sum there
    and puts that by hs under "hs". ``out_of`` is that of ``outputs``, where many calls have the same parameters.

    Rows are brought into the order of their classes. Logits of the classes are one product for all rows, those of the words
    one for each class; all else is done for all rows at once.
    """
    size, n, kind = len(p["bo"]) // CLASSES, len(y), hs.dtype
    cls = y // size
    order = np.argsort(cls.astype(np.int16), kind="stable")  # sorted by radix, as it is short
    h = _room("h", (n, HIDDEN + 1), kind)
    h[:, :HIDDEN] = hs[order]
    h[:, HIDDEN] = 1  # for the biases
    y = y[order]
    cls = y // size
    own = y - cls * size
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    parts = [(c, bounds[c], bounds[c + 1]) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]
    to_class, to_word, most = out_of or outputs(p, kind)
    reach = max(1.0, float(np.abs(hs).max(initial=0)))
    safe = most * reach <= _SAFE
    rows = np.arange(n)
    x, words = _room("classes", (n, CLASSES), kind), _room("words", (n, size), kind)
    np.matmul(h, to_class, out=x)
    for c, a, b in parts:
        np.matmul(h[a:b], to_word[c * size : (c + 1) * size].T, out=words[a:b])
    lp, sums = np.zeros(n, kind), []
    places = [rows * CLASSES + cls, rows * size + own]
    for logits, at in zip((x, words), places):
        if not safe:
            logits -= logits.max(1, keepdims=True)
        lp += logits.ravel().take(at)
        np.exp(logits, out=logits)
        sums.append(logits @ np.ones(logits.shape[1], kind))
        lp -= np.log(sums[-1])
    out = np.empty(n, kind)
    out[order] = lp
    if grads is not None:
        # a row's gradient is what stands here by its sum; what the rows meet or come to has fewer columns, so that is divided
        for logits, at, total in zip((x, words), places, sums):
            logits.ravel()[at] -= total
        by_class, by_word = (1 / total[:, None] for total in sums)
        scaled = _room("scaled", h.shape, kind)
        np.multiply(h, by_class, out=scaled)
        d = scaled.T @ x
        grads["Wc"] += d[:HIDDEN]
        grads["bc"] += d[HIDDEN]
        dh = x @ to_class[:HIDDEN].T
        dh *= by_class
        np.multiply(h, by_word, out=scaled)
        d, back, weights = _room("of_words", (CLASSES, size, HIDDEN + 1), kind), _room("back", dh.shape, kind), p["Wo"].reshape(CLASSES, size, HIDDEN)
        d[:] = 0
        for c, a, b in parts:
            own = words[a:b]
            np.matmul(own.T, scaled[a:b], out=d[c])
            np.matmul(own, weights[c], out=back[a:b])
        grads["Wo"].reshape(weights.shape)[:] += d[:, :, :HIDDEN]
        grads["bo"].reshape(CLASSES, size)[:] += d[:, :, HIDDEN]
        back *= by_word
        dh += back
        grads["hs"] = np.empty_like(dh)
        grads["hs"][order] = dh
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-probability over a window, its gradients as one vector (``flat``), and the state at its end."""
    total = max(1, int(mask.sum()))
    vector = np.zeros(sum(v.size for v in p.values()), np.float32)
    g = unflat(vector, len(p["bo"]))
    kind = h.dtype
    pasts = _room("pasts", (*x.shape, HIDDEN), kind)
    # what the window's own words add to the gates, each once
    ids = x.ravel()
    order = np.argsort(ids.astype(np.min_scalar_type(len(p["E"]))), kind="stable")  # sorted by radix where ids are short
    starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
    used = ids[order[starts]]
    place = np.empty(len(ids), np.int64)
    place[order] = np.repeat(np.arange(len(used)), np.diff(starts, append=len(ids)))
    own = p["E"][used]
    states, (z, r, c) = run(p, _by_gate(own @ p["W"] + p["b"]), place.reshape(x.shape), h, pasts)
    told = np.flatnonzero(mask)
    lp = log_probs(p, states[1:].reshape(-1, HIDDEN).take(told, axis=0), y.ravel().take(told), g)
    dhs = _room("dhs", pasts.shape, kind)
    dhs[:] = 0
    dhs.reshape(-1, HIDDEN)[told] = g.pop("hs")
    # what a change of a state does by each gate: (h - c) z (1 - z), past r (1 - r), (1 - z) (1 - c c)
    by_z, by_r, by_c, not_z = (_room(name, pasts.shape, kind) for name in ("by_z", "by_r", "by_c", "not_z"))
    np.subtract(1, z, out=not_z)
    np.subtract(states[:-1], c, out=by_z)
    by_z *= z
    by_z *= not_z
    np.subtract(1, r, out=by_r)
    by_r *= r
    by_r *= pasts
    np.multiply(c, c, out=by_c)
    np.subtract(1, by_c, out=by_c)
    by_c *= not_z
    # by what the inputs add to the gates, and by what the states add
    d, du = _room("d", (3, *pasts.shape), kind), _room("du", (3, *pasts.shape), kind)
    back = np.ascontiguousarray(p["U"].T).reshape(3, HIDDEN, HIDDEN)
    carry, three = np.zeros_like(h), _room("three", (3, *h.shape), kind)
    for t in range(len(x) - 1, -1, -1):
        dh = dhs[t]
        dh += carry
        np.multiply(dh, by_z[t], out=d[0, t])
        np.multiply(dh, by_c[t], out=d[2, t])
        np.multiply(d[2, t], by_r[t], out=d[1, t])
        du[:2, t] = d[:2, t]
        np.multiply(d[2, t], r[t], out=du[2, t])
        np.matmul(du[:, t], back, out=three)
        np.multiply(dh, z[t], out=carry)
        for part in three:
            carry += part
    d, du, before = d.reshape(3, -1, HIDDEN), du.reshape(3, -1, HIDDEN), states[:-1].reshape(-1, HIDDEN)
    # sums by word come last, when the gates are one
    weights, inputs, at_inputs = p["W"].reshape(HIDDEN, 3, HIDDEN), own.take(place, axis=0).T, 0
    for k in range(3):
        at = slice(k * HIDDEN, (k + 1) * HIDDEN)
        g["U"][:, at] += before.T @ du[k]
        g["W"][:, at] += inputs @ d[k]
        g["b"][at] += np.ones(len(ids), kind) @ d[k]
        at_inputs += d[k] @ weights[:, k].T
    g["E"][used] += np.add.reduceat(at_inputs.take(order, axis=0), starts, axis=0)
    vector /= total
    return -float(lp.sum()) / total, vector, states[-1]


class Adam:
    """Adam steps on parameters that are views of one vector."""

    def __init__(self, vector: np.ndarray, rate: float):
        self.p, self.rate, self.t = vector, np.float32(rate), 0
        self.m, self.v = np.zeros_like(vector), np.zeros_like(vector)

    def step(self, g: np.ndarray, share: float = 1.0) -> None:
        """By gradients ``g``, which are used up, and so long a share of a whole step."""
        size, part = float(np.sqrt(g @ g)), _room("part", g.shape, g.dtype)
        if size > 1.0:
            g *= np.float32(1.0 / size)
        self.t += 1
        rate = np.float32(share) * self.rate * np.float32(np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        self.m *= np.float32(0.9)
        self.m += np.multiply(g, np.float32(0.1), out=part)
        np.multiply(g, g, out=g)
        g *= np.float32(0.01)
        self.v *= np.float32(0.99)
        self.v += g
        np.sqrt(self.v, out=g)
        g += np.float32(1e-6)
        np.divide(self.m, g, out=g)
        g *= rate
        self.p -= g


#: Tokens of waiting documents that are laid end to end at once.
_LAID = 1 << 22


def windows(docs: Iterator[tuple[object, np.ndarray]], lanes: int, steps: int, stretch: int = 1) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (name, ids with END) side by side: names of those that begin, x, y, mask (steps, lanes), the lanes' numbers, and
    which of them begin a document. A lane takes its next document when one is over, so states can be carried from window to
    window. Where only a few lanes are left, windows have up to ``stretch`` times the steps, but no more tokens than others."""
    laid = np.full(1, END, np.int32)
    at, end = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # of what each lane still has to give
    waiting: list[tuple[object, int, int]] = []  # from the last to the first
    more = True
    while True:
        free = np.flatnonzero(at == end)
        if more and len(waiting) < len(free):
            # lay out anew: what the lanes hold, each with the token before it, then what waits, then new documents
            parts, length = [np.full(1, END, np.int32)], 1
            for k in np.flatnonzero(at < end):
                parts.append(laid[at[k] - 1 : end[k]])
                at[k], end[k] = length + 1, length + len(parts[-1])
                length += len(parts[-1])
            queue, room = [], _LAID
            for name, a, b in reversed(waiting):
                parts.append(laid[a:b])
                queue.append((name, length, length + b - a))
                length += b - a
            while room > 0 or len(queue) < len(free):
                found = next(docs, None)
                if found is None:
                    more = False
                    break
                parts.append(found[1])
                queue.append((found[0], length, length + len(found[1])))
                length += len(found[1])
                room -= len(found[1])
            # the longest first, so that they don't go on by themselves at the end
            laid, waiting = np.concatenate(parts), sorted(queue, key=lambda x: x[2] - x[1])
        names, fresh = [], np.zeros(lanes, bool)
        for k in free[: len(waiting)].tolist():
            name, at[k], end[k] = waiting.pop()
            names.append(name)
            fresh[k] = True
        live = np.flatnonzero(at < end)
        if not len(live):
            return
        begins = fresh[live]
        left = end[live] - at[live]
        n = max(steps, min(steps * min(stretch, lanes // len(live)), int(left.max())))
        where = at[live] + np.arange(n)[:, None]
        mask = where < end[live]
        np.minimum(where, end[live] - 1, out=where)
        y, x = np.where(mask, laid[where], np.int32(END)), np.where(mask, laid[where - 1], np.int32(END))
        x[0, begins] = END
        at[live] = at[live] + np.minimum(left, n)
        yield names, x, y, mask, live, begins


def train(vector: np.ndarray, vocabulary: int, docs: Iterator[tuple[object, np.ndarray]], lanes: int, steps: int, rate: float, stretch: int = 1) -> int:
    """Train the parameters of ``vector`` (``flat``) in place, by the gradient of every window. A step is the shorter the fewer
    tokens its window has, so that the last long documents, when few lanes are left, don't outweigh all others. Returns the
    tokens read."""
    p = unflat(vector, vocabulary)
    adam, state, read = Adam(vector, rate), np.zeros((lanes, HIDDEN), np.float32), 0
    for _, x, y, mask, live, begins in windows(docs, lanes, steps, stretch):
        h = state[live]
        h[begins] = 0
        _, g, state[live] = gradients(p, x, y, mask, h)
        tokens = int(mask.sum())
        adam.step(g, min(1.0, tokens / (lanes * steps)))
        read += tokens
    return read


def score(p: dict[str, np.ndarray], docs: Iterator[tuple[object, np.ndarray]], lanes: int, steps: int, stretch: int = 1) -> Iterator[tuple[object, float]]:
    """Log10-probability of each whole document, as it ends."""
    table, state = inputs(p), np.zeros((lanes, HIDDEN), np.float32)
    sums, out_of = np.zeros(lanes), outputs(p, state.dtype)
    before: dict[int, object] = {}
    for names, x, y, mask, live, begins in windows(docs, lanes, steps, stretch):
        h = state[live]
        h[begins] = 0
        for k, name in zip(live[begins].tolist(), names):
            if k in before:
                yield before[k], float(sums[k])
            before[k], sums[k] = name, 0.0
        states = run(p, table, x, h)[0]
        state[live] = states[-1]
        lp, hs, ys = np.zeros(x.shape), states[1:][mask], y[mask]
        lp[mask] = np.concatenate([log_probs(p, hs[i : i + _ROWS], ys[i : i + _ROWS], out_of=out_of) for i in range(0, len(ys), _ROWS)])
        sums[live] += lp.sum(0) / np.log(10)
    for k, name in before.items():
        yield name, float(sums[k])
