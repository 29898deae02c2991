import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp
from test_mixing import slow_targets
from test_quality import slow_verdicts
from test_shingles import by_brute_force

from factloom.llm.shared import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def slow_cuts(texts, length=200, words=50):
    """Each text without the stretches of so many words that strings with a twin cover."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r) + 1)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept, at = b"", 0
        for m in re.finditer(b"\1+", bytes(gone)):
            a, b = m.span()
            if len(r[a:b].split()) >= words:
                kept, at = kept + r[at:a], b
        out.append(kept + r[at:])
    return out


def test_stages_one_by_one(spark, sf):
    docs = documents(spark, sf).limit(120)
    rows = docs.collect()
    kept = cp.quality_rules(spark, docs, sf)
    verdicts = slow_verdicts([(r.text, r.lang) for r in rows], 50)
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r, v in zip(rows, verdicts) if v[2])
    one = cp.simhash_near_dedup(spark, docs, sf)
    groups = {}
    for r, g in zip(rows, by_brute_force([r.text for r in rows])):
        groups.setdefault(g, []).append(r.doc_id)
    assert one.columns == COLUMNS and sorted(r.doc_id for r in one.collect()) == sorted(min(g) for g in groups.values())
    cut = cp.suffix_array_dedup(spark, docs, sf)
    got = {r.doc_id: r for r in cut.collect()}
    for r, left in zip(rows, slow_cuts([r.text for r in rows])):
        if r.doc_id in got:
            text = got[r.doc_id].text
            assert 0 <= len(left) - len(text.encode()) <= 8 and got[r.doc_id].n_chars == len(text)
        else:
            assert len(left.strip()) <= 8
    mixed = cp.mix_sources(spark, docs, sf)
    assert mixed.columns == COLUMNS
    n, words, taken = Counter(), Counter(), Counter()
    for r in mixed.collect():
        n[r.doc_id] += 1
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in rows:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    longest = max(len(r.text.split()) for r in rows)
    want = slow_targets(words)
    assert max(n.values()) <= 2 and all(abs(taken[s] - want[s]) <= longest / 2 + 1 for s in words)
    assert cp.bpe_tokens(spark, mixed, sf).count() == mixed.count()


def test_columns_of_any_name_pass_all_stages(spark):
    prose = [" ".join(f"{chr(97 + k % 26)}{i * k % 97}" for i in range(80)) for k in range(1, 40)]
    extra = ["kept", "size", "k1", "n_removed", "digest", "root", "row", "first", "copies", "t0", "_lang", "_name", "runs"]
    rows = [(k, t, "en", "s", len(t), *extra) for k, t in enumerate(prose)]
    docs = spark.createDataFrame(rows, [*COLUMNS, *extra])
    for name, step in cp.STAGES[:-1]:
        out = step(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0, name
        assert tuple(out.first())[5:] == tuple(extra)


def test_whole_pipeline_and_empty_table(spark, sf):
    out = cp.run(spark, sf).collect()
    assert out and all(r.n_tokens > 0 for r in out)
    docs = documents(spark, sf).limit(0)
    for _, step in cp.STAGES:
        docs = step(spark, docs, sf)
    assert docs.count() == 0
