import hashlib
import random
import re
from collections import Counter

from factloom.llm import repeats
from factloom.llm.repeats import Strings, removals, repeated_places, without_repeats


def slow(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def some_texts(seed):
    rnd = random.Random(seed)
    words = ["the", "of", "sea", "émile", "sun", "x", "日本", "tree", "and\n"]
    prose = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "", str(rnd.randrange(100))]) for _ in range(n))
    passages = [prose(n) for n in (60, 90, 130, 200, 400)]
    texts = [prose(300) for _ in range(6)]
    for _ in range(25):
        p = rnd.choice(passages)
        a, b = sorted(rnd.sample(range(len(p) + 1), 2))
        texts.append(prose(rnd.randrange(60)) + p[a // 2 : b + (len(p) - b) // 2] + prose(rnd.randrange(60)))
    base = prose(700)
    for _ in range(8):
        i = rnd.randrange(len(base))
        texts.append(base[:i] + "edit" + base[i + 3 :])
    texts += [texts[0], base, base, "ab" * 600, "a" * 1000, "ab" * 250 + prose(50), "q" * 399, "q" * 400, "q" * 401 + "z", None, "", prose(30) + passages[3] + prose(9) + passages[3]]
    texts.append(("line " + "z" * 90 + "\n") * 12)
    return texts


def test_every_covered_byte_goes(spark):
    for seed, length in ((1, 400), (2, 400), (1, 200), (2, 60)):
        texts = some_texts(seed)
        docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 int, runs string")
        out = {r.doc_id: tuple(r[1:]) for r in removals(docs, length).collect()}
        assert [out[i] for i in range(len(texts))] == slow(texts, length)


def slow_texts(texts, length, words):
    """Each text without the stretches of so many words that strings with a twin cover; cut characters go wholly."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for t, r in zip(texts, raws):
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        for m in re.finditer(b"\1+", bytes(gone)):
            if len(r[m.start() : m.end()].split()) < words:
                gone[m.start() : m.end()] = [False] * (m.end() - m.start())
        kept, at = "", 0
        for c in t or "":
            n = len(c.encode())
            kept += "" if any(gone[at : at + n]) else c
            at += n
        out.append(None if t is None else kept)
    return out


def test_two_lengths_of_one_parse(spark, monkeypatch):
    for seed, passages, words in ((4, 200, 20), (5, 90, 0)):
        texts = some_texts(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for crowd in (20_000, 1):
            monkeypatch.setattr(repeats, "CROWD", crowd)
            out = {r.doc_id: tuple(r)[1:] for r in removals(docs, 400, passages, words).collect()}
            assert [out[i][:4] for i in range(len(texts))] == slow(texts)
            assert [out[i][4] for i in range(len(texts))] == slow_texts(texts, passages, words)


def test_crowded_suffixes_and_cut_runs_give_the_same(spark, monkeypatch):
    texts = some_texts(3)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")

    room = {repeats.text_key((t or "").encode()): {n: range(len((t or "").encode()) - n + 1) for n in (90, 200)} for t in texts}

    def places(crowd):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        return {(r.k1, r.k2, r.length, i) for r in repeated_places(docs, Strings(90, (200,))).collect() for i in range(r["first"], r["last"] + 1) if i in room[r.k1, r.k2][r.length]}

    assert places(1) == places(20_000) and places(1)
    monkeypatch.setattr(repeats, "_STEP", 100)
    whole = [x for part in repeats.parse(texts[0].encode()) for x in part[0].tolist()]
    assert len(whole) > 5


def test_edge_cases_and_the_cut_texts(spark):
    rows = [(None, None), (None, "é" * 300), (1, "é" * 300), (1, "x" + "é" * 300 + "y"), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r.doc_id, *tuple(r)[1:]) for r in removals(docs).collect())
    assert out == Counter((d, *s) for (d, _), s in zip(rows, slow([t for _, t in rows])))
    assert removals(docs.limit(0)).count() == 0
    cut = {(r.doc_id, r.text) for r in without_repeats(docs).select("row.*").collect()}
    assert cut == {(None, None), (None, ""), (1, ""), (1, "xy"), (2, "short")}


def test_stretches_of_few_words_stay_and_clashing_columns_pass(spark):
    own = lambda k: " ".join(f"{chr(97 + k)}{i}{chr(97 + k)}" for i in range(60))
    long, short = " ".join(f"word{i}" for i in range(51)), "x" * 250
    rows = [(k, f"{own(k)}/{long}/{own(k + 9)} {short} {own(k + 14)}", 7, "s") for k in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, suffix string")
    out = without_repeats(docs, Strings(200), 50).select("row.*").collect()
    # the slashes are repeated as well
    assert sorted(map(tuple, out)) == [(k, f"{own(k)}{own(k + 9)} {short} {own(k + 14)}", 7, "s") for k in (1, 2, 3)]


def test_passages_of_51_words_below_the_length_are_told(spark):
    own = lambda k: " ".join(f"{chr(97 + k)}{i}{chr(97 + k)}" for i in range(60))
    passage, short = " ".join(f"w{i}or" for i in range(51)), " ".join(f"longer{i}words" for i in range(20))
    assert len(passage) < 400 and len(short) > 200
    rows = [(1, f"{own(1)}/{passage}/{own(2)}"), (2, f"{own(3)}/{passage}/{own(4)}"), (3, f"{own(5)} {short} {own(6)}"), (4, f"{own(7)} {short} {own(8)}"), (5, None), (6, own(9))]
    out = {r.doc_id: r for r in removals(spark.createDataFrame(rows, "doc_id long, text string"), 400, passages=200, texts=False).collect()}
    # the contract's columns are about strings of 400 bytes alone; the slashes are repeated as well
    assert [tuple(out[i])[1:5] for i, _ in rows] == slow([t for _, t in rows])
    assert {i: (r.n_passages, r.n_passage_bytes) for i, r in out.items()} == {1: (1, len(passage) + 2), 2: (1, len(passage) + 2), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}


def test_the_query_tells_passages_behind_the_contracts_columns(spark, sf):
    from factloom.llm.queries import QUERIES

    out = QUERIES["op6_prefix_free_repeats"](spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]
    # who loses 400 bytes of 50 words has a passage
    assert out.filter("n_passages > 0").count() > 0 and out.filter("n_passages = 0 AND n_passage_bytes > 0").count() == 0
