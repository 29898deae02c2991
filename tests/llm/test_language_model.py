import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from factloom.llm import gru
from factloom.llm.language_model import Settings, counted, score_documents, split


def small_model():
    p = gru.initial(np.arange(1, 129)[::-1].astype(float))
    rnd = np.random.default_rng(3)
    return {k: (v + rnd.standard_normal(v.shape) * 0.2).astype(np.float64) for k, v in p.items()}


def test_gradients_against_differences():
    p = small_model()
    rnd = np.random.default_rng(5)
    x, y = rnd.integers(0, 128, (4, 3)), rnd.integers(0, 128, (4, 3))
    mask, h = np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 0]], bool), rnd.standard_normal((3, gru.HIDDEN))
    _, vector, _ = gru.gradients(p, x, y, mask, h)
    g = gru.unflat(vector, 128)
    for name in gru.NAMES:
        for _ in range(4):
            at = tuple(rnd.integers(0, n) for n in p[name].shape)
            if name == "E":
                at = (x.ravel()[rnd.integers(x.size)], at[1])
            if name in ("Wo", "bo"):
                at = (y[mask][rnd.integers(mask.sum())], *at[1:])
            old, step = p[name][at], 1e-5
            p[name][at] = old + step
            up = gru.gradients(p, x, y, mask, h)[0]
            p[name][at] = old - step
            down = gru.gradients(p, x, y, mask, h)[0]
            p[name][at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-6, name


def test_probabilities_sum_to_one_and_windows_carry_the_state():
    p = small_model()
    hs = np.random.default_rng(1).standard_normal((1, gru.HIDDEN)).repeat(128, 0)
    assert abs(np.exp(gru.log_probs(p, hs, np.arange(128))).sum() - 1) < 1e-9
    p = {k: v.astype(np.float32) for k, v in p.items()}
    rnd = np.random.default_rng(2)
    docs = [(i, np.append(rnd.integers(1, 128, n), 0).astype(np.int32)) for i, n in enumerate([0, 1, 5, 300, 31, 32, 33, 64, 2, 700])]
    one = dict(gru.score(p, iter(docs), 1, 5000))
    for lanes, steps in ((3, 7), (16, 32), (2, 1)):
        got = dict(gru.score(p, iter(docs), lanes, steps))
        assert all(abs(got[i] - one[i]) < 1e-2 for i in one) and got.keys() == one.keys()


def slow_base(rows):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    return [(d, h, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None])) for (d, t), h in zip(rows, held)]


def compare(rows, out):
    got = sorted(((r.doc_id or -1, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score) for r in out), key=str)
    want = sorted(((d or -1, n, h, k, t, b) for d, h, n, k, t, b in slow_base(rows)), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-6 * abs(w[5]) + 1e-9 for g, w in zip(got, want))


def test_scores_beat_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for common in (300_000, 5000):  # with and without words that are joined
        out = score_documents(docs, Settings(common_words=common, train_lanes=32)).collect()
        compare(rows, out)
        held = [r for r in out if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
        assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "A b É"), (2, ""), (4, "a B é A"), (5, "x\x1cy\x85z " * 30_000), (30, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(rows, score_documents(docs, Settings(common_words=3)).collect())
    assert score_documents(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "a") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    compare([tuple(r) for r in only.collect()], score_documents(only).collect())


def test_every_window_trains_the_model():
    s = Settings()
    vector = gru.flat(small_model()).astype(np.float32)
    old = gru.unflat(vector.copy(), 128)
    # in one lane each document fills a window of its own
    docs = [(None, np.append(np.full(s.train_steps - 1, 10 * k), 0).astype(np.int32)) for k in range(1, 5)]
    assert gru.train(vector, 128, iter(docs), 1, s.train_steps, s.rate) == 4 * s.train_steps
    p = gru.unflat(vector, 128)
    assert all((p["E"][10 * k] != old["E"][10 * k]).any() for k in range(1, 5))


def test_output_weights_are_laid_out_once_for_a_scoring(monkeypatch):
    made, outputs = [], gru.outputs
    monkeypatch.setattr(gru, "outputs", lambda *a: made.append(1) or outputs(*a))
    rnd = np.random.default_rng(4)
    p = gru.initial(rnd.integers(1, 50, 128).astype(float))
    p["Wc"][:], p["Wo"][:] = rnd.standard_normal(p["Wc"].shape), rnd.standard_normal(p["Wo"].shape)
    docs = [(k, rnd.integers(0, 128, 40).astype(np.int32)) for k in range(30)]
    got = dict(gru.score(p, iter(docs), 4, 8))
    assert len(made) == 1
    for name, ids in docs:  # the same from weights laid out anew
        x = np.append(np.int32(gru.END), ids[:-1])[:, None]
        states = gru.run(p, gru.inputs(p), x, np.zeros((1, gru.HIDDEN), np.float32))[0]
        assert abs(got[name] - gru.log_probs(p, states[1:, 0].copy(), ids).sum() / np.log(10)) < 1e-3


def test_words_of_a_batch_are_told_apart_and_counted_at_once():
    texts = ["The the\x0bsea  THE É é ", None, "", " \t", "sea\x1cx \x85 \xa0sea\u3000y", "q" * 70, "\n the"] * 3
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    words, codes, bounds = split(pa.array(texts, pa.string()).slice(1))
    known = words.to_pylist()
    assert len(set(known)) == len(known)
    assert [[known[c] for c in codes[a:b]] for a, b in zip(bounds, bounds[1:])] == want[1:]
    for most in (1, 4, 100):  # passed on at once, in between, and at the end
        got = Counter()
        for batch in counted((pa.array([t], pa.string()) for t in texts), most):
            for row in batch.to_pylist():
                got[row["word"]] += row["n"]
        assert got == Counter(w for one in want for w in one) and b"" not in got
    assert sum(b.num_rows for b in counted(iter([pa.array([None], pa.string())]), 9)) == 0 and not list(counted(iter([]), 9))


def test_gradients_of_large_logits_are_those_of_64_bits():
    for scale in (0.05, 1.1, 4.0):  # the middle one's logits are just under what is taken as they are, the last one's over
        rnd = np.random.default_rng(6)
        p = {k: (v * 0 + rnd.choice([-1.0, 1.0], v.shape) * scale * 4).astype(np.float32) for k, v in small_model().items()}
        x, y = rnd.integers(0, 128, (5, 9)), rnd.integers(0, 128, (5, 9))
        mask, h = rnd.random((5, 9)) < 0.7, np.tanh(rnd.standard_normal((9, gru.HIDDEN)))
        one, vector, _ = gru.gradients(p, x, y, mask, h.astype(np.float32))
        vector = vector.copy()
        two, exact, _ = gru.gradients({k: v.astype(np.float64) for k, v in p.items()}, x, y, mask, h)
        assert np.isfinite(vector).all() and abs(one - two) < 1e-3 * two
        assert np.abs(vector - exact).max() < 2e-3 * np.abs(exact).max()
