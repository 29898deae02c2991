import math
import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import quality, queries


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    seen, cover, lines, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
TEXTS = ["", " ", "a b c a b c\na b c", "x | y\n\nx | y\n \n", "#*$ é😀 日本\x0b\x0ca\rb", "  lead trail  ", "the of " * 80, "a\x1cb\x85c d\xa0e"]


def judged(spark, texts, **rules):
    rows = [(i, t, "en" if i % 2 else None, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, common string")  # a name that clashes
    return sorted(quality.judged(docs, quality.Rules(**rules)).select("row.*", *ADDED).collect(), key=lambda r: r.doc_id)


def test_base_measures(spark):
    texts = [None, *TEXTS]
    for text, row in zip(texts, judged(spark, texts)):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == base(text), text
        assert not (row.base_failed and row.kept)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n\t|é", max_size=80), min_size=1, max_size=40))
def test_base_measures_at_random(spark, texts):
    for text, row in zip(texts, judged(spark, texts)):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == base(text)


def test_junk_goes_and_clean_stays(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    clean = ["The text. " + " ".join(f"{word()} {rnd.choice(['and', 'the', 'of'])} {word()}" for _ in range(60)) for _ in range(120)]
    junk = [" | ".join(word() for _ in range(70)) for _ in range(6)]
    rows = judged(spark, [x for c in clean for x in (c, c + ".")] + junk, least_documents=20)
    assert all(r.kept for r in rows[:240] if not r.base_failed) and any(r.kept for r in rows)
    assert not any(r.kept for r in rows[240:])


def slow_verdicts(rows, least):
    """Distances and verdicts of (text, lang) by counting words and characters one by one."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t, _ in rows]
    kinds = ["abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?'\"()-", "0123456789", "#*$%&|<>"]
    failed = [base(t)[-1] for t, _ in rows]
    own = {}
    for lang in {lang for _, lang in rows}:
        of = [k for k, r in enumerate(rows) if r[1] == lang]
        if len(of) < least:
            continue
        seen = Counter(w for k in of for w in set(words[k]) if w.isalpha())
        common = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:32]]

        def histograms(k):
            t, n = rows[k][0] or "", Counter(words[k])
            cls = [sum(c in kind for c in t) for kind in kinds]
            at = [n[w] for w in common]
            return [*cls, len(t) - sum(cls)], [*at, len(words[k]) - sum(at)]

        own[lang] = histograms
    refs = {}
    for lang, histograms in own.items():
        good = [histograms(k) for k, r in enumerate(rows) if r[1] == lang and not failed[k]]
        shares = [[1000 * x // sum(c) for x in c] for c, _ in good]
        medians = [sorted(s)[(len(s) + 1) // 2 - 1] for s in zip(*shares)]
        refs[lang] = medians, [sum(1_000_000 * w[i] // sum(w) for _, w in good) for i in range(len(good[0][1]))] if good else None

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(max(0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2))

    out = []
    for k, (t, lang) in enumerate(rows):
        c = w = None
        if lang in refs and refs[lang][0]:
            cls, at = own[lang](k)
            c = distance(cls, refs[lang][0]) if len(t or "") >= 200 else None
            w = distance(at, refs[lang][1]) if len(words[k]) >= 50 else None
        out.append((c, w, not failed[k] and (c or 0) <= 0.18 and (w or 0) <= 0.42))
    return out


def test_distances_and_verdicts_against_slow_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("lang"))
    rows = docs.collect()
    out = {r.doc_id: r for r in quality.judged(docs, quality.Rules(least_documents=30)).select("row.doc_id", *ADDED).collect()}
    want = slow_verdicts([(r.text, r.lang) for r in rows], 30)
    assert len({w[2] for w in want}) == 2 and any(w[0] is None for w in want)
    for r, (c, w, kept) in zip(rows, want):
        got = out[r.doc_id]
        assert (got.class_distance, got.word_distance, got.kept) == (pytest.approx(c, abs=1e-9), pytest.approx(w, abs=1e-9), kept)


def test_rare_languages_are_judged_by_the_base_rule_alone(spark):
    text = " ".join(f"слово{i}" for i in range(60))
    rows = judged(spark, [text] * 5)
    assert all(r.kept and r.class_distance is None for r in rows)


def test_empty_clash_and_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert quality.judged(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("source", "kept").withColumn("t", F.lit(1))
    assert quality.judged(clash).select("row.*").columns == clash.columns
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id")
    got = {(r.quality, r.kept): r.n for r in out.filter("NOT base_failed").groupBy("quality", "kept").count().withColumnRenamed("count", "n").collect()}
    assert got.get((1, False), 0) <= 0.02 * got[1, True]
    assert got.get((0, True), 0) <= 0.1 * max(1, got.get((0, False), 0))


def test_sql_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.OP5_SQL).fetchall()
    assert len({r[-1] for r in want}) == 2
    assert sorted(map(tuple, queries.op5_quality_divergence(spark, sf).collect())) == sorted(want)
