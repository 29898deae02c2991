import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp
from test_simhash import same_parts

from factloom.llm import shingles, simhash


def by_brute_force(texts):
    found = []
    for t in texts:
        w = (t or "").lower().split()
        found.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def some_texts():
    rnd = random.Random(4)
    prose = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    line = prose(40)
    texts = [None, "", "One", "one", "a b c d e"]
    for _ in range(6):
        base = prose(100)
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6):
            w = list(base)
            for k in rnd.sample(range(100), edits):
                w[k] = "edited"
            texts.append(" ".join(w))
        texts += [" ".join(base + prose(n)) for n in (8, 23, 24, 25, 60)]
    chain = prose(120)
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 20, 4)]
    texts += [" ".join(line + prose(n)) for n in (3, 5, 30, 50, 60, 60, 60)]  # one common line
    return texts


def test_one_edited_word_and_an_added_sentence_are_near_copies(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:50] + ["other"] + base[51:])), (3, " ".join(base + ["one", "more", "short", "sentence", "here"])), (4, " ".join(base[:50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.simhash_near_dedup(spark, docs, "").collect()) == [1, 4]


@pytest.mark.parametrize("common", [32, 1])
def test_groups_against_brute_force(spark, common):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, root string")  # a name that clashes
    rows = simhash.similar_groups(docs, common=common).select("row.doc_id", "row.root", F.col("root").alias("of"), "first").collect()
    assert len(rows) == len(texts) and all(r.root == "k" for r in rows)
    of = {r.doc_id: r.of for r in rows}
    assert same_parts([of[i] for i in range(len(texts))], by_brute_force(texts))
    least = {}
    for r in rows:
        least[r.of] = min(least.get(r.of, r.doc_id), r.doc_id)
    assert {r.doc_id for r in rows if r.first} == set(least.values())


@pytest.mark.parametrize("least", [0, 1])
def test_many_edited_copies_of_one_text(spark, monkeypatch, least):
    rnd, seen = random.Random(5), []
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(160):
        w = list(base)
        for i in rnd.sample(range(150), rnd.randint(least, 6)):
            w[i] = f"e{rnd.randrange(40)}" if k % 4 else f"own{k}x{i}"
        texts.append(" ".join(w))
    crowded = shingles._crowded
    monkeypatch.setattr(shingles, "_crowded", lambda rows: seen.append(crowded(rows)) or seen[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.doc_id: r.root for r in simhash.similar_groups(docs, common=4).select("row.doc_id", "root").collect()}
    want = by_brute_force(texts)
    assert seen == [True] and 2 < len(set(want)) < 160
    assert same_parts([of[i] for i in range(len(texts))], want)


def test_one_row_of_each_group_whatever_the_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a), (None, a), (None, b), (5, b), (5, b), (5, "c d e"), (7, a + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(map(tuple, got)) == [(5, b), (5, "c d e"), (7, a + " z")]
    assert cp.simhash_near_dedup(spark, docs.limit(0), "").count() == 0
