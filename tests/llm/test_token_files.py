import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import rans, token_files
from factloom.llm.token_files import Lately, LibraryWords, read_token_files, token_file_digests, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 299), min_size=1, max_size=40), st.integers(1, 4000))
def test_blocks_round_trip(some, n):
    ids = np.resize(np.array(some, np.uint32), n)
    table = rans.quantise(np.bincount(ids, minlength=300))
    assert table.freq.sum() == 1 << rans.TABLE_BITS and table.freq.min() >= 1
    lanes, payload, marks = rans.encode_block(ids, table)
    assert (rans.decode_block(n, lanes, payload, marks, table) == ids).all()


def test_checkpoints_decode_alone_and_damage_is_seen():
    ids = np.random.default_rng(1).zipf(1.3, 400_000).clip(max=999).astype(np.uint32)
    table = rans.quantise(np.bincount(ids, minlength=1000))
    blocks = rans.Blocks(table)
    assert not list(blocks.add(7, ids[:1000])) and not list(blocks.add(8, ids[1000:]))
    block = blocks.close()
    step = rans.CHECKPOINT_ROWS * block["lanes"]
    part = rans.decode_block(len(ids), block["lanes"], block["payload"], block["checkpoints"], table, 1, 3)
    assert (part == ids[step : 3 * step]).all()
    p = np.bincount(ids) / len(ids)
    assert len(block["payload"]) * 8 < 1.02 * len(ids) * -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert [d for d, _ in rans.read_block(block, table)] == [7, 8]
    with pytest.raises(ValueError):
        rans.read_block(block | {"payload": block["payload"][:-1] + b"\xff"}, table)


def test_words_as_the_library_has_them():
    lib, words = Tokenizer.from_file(PATH), LibraryWords(PATH)
    texts = ["don't  it's é", None, "", "<|endoftext|> x<|startoftext|>", "ΑΣ İ. 日本\x1cx", "z" * 300, "The of. the, OF", "x\u0663y \u0663 a\u0663", "é ñandú ÜBER über"]
    for text, ids in zip(texts, words.encode_batch(texts)):
        assert np.frombuffer(ids, words.kind).tolist() == lib.encode(text or "", add_special_tokens=False).ids


def test_words_that_differ_in_case_and_punctuation_ask_the_library_once():
    lib, words, asked = Tokenizer.from_file(PATH), LibraryWords(PATH), []

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return lib.model.tokenize(piece)

    class Library:
        model = Model()

        def encode(self, text, **options):
            asked.append(text)
            return lib.encode(text, **options)

    words.library = Library()
    texts = ["Sea sea SEA, sea. sea!! Sea&&&", "sea?! (sea) it's sea's sea' É! é!", "a_ a_b _ É\u0301! <| sea<|endoftext|> sea<| ..."]
    for text, ids in zip(texts, words.encode_batch(texts)):
        assert np.frombuffer(ids, words.kind).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert asked.count("sea") == 1 and not any(x in asked for x in ("sea!!", "Sea&&&", "sea?!"))
    assert not any("Sea&&&" in x for x in asked)


def test_python_sees_each_stem_of_a_batch_once(monkeypatch):
    seen, both = [], Lately.all
    monkeypatch.setattr(Lately, "all", lambda self, words: seen.extend(words.to_pylist()) or both(self, words))
    lib, words = Tokenizer.from_file(PATH), LibraryWords(PATH)
    texts = ["Sea sea SEA, sea. " * 500, None, "", "sea?! it's\xa0Sea\u3000. É\u0301 été.", " \t\n\x0b", "<|endoftext|>! <|ENDOFTEXT|> sea<|startoftext|>", "\x85 à\u0300 \u03a3 \u0130."] * 3
    got = words.encode_array(pa.array(texts, pa.string()).slice(1), b"\2\0")
    assert [np.frombuffer(x, words.kind).tolist() for x in got.to_pylist()] == [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[1:]]
    assert seen.count("sea") == 1 and len(seen) < 40
    assert words.encode_array(pa.array(texts, pa.large_string()).slice(1), b"\2\0") == got
    assert words.encode_array(pa.array([], pa.string())).to_pylist() == [] and words.encode_array(pa.array([None], pa.string())).to_pylist() == [b""]


def test_words_are_remembered_in_two_generations(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 3)
    made, memo = [], Lately(lambda w: made.append(w) or (None if w == "c" else w.encode()))
    for some in (["a", "b", "c", "d"], ["a", "c", "x" * 99], ["x" * 99, "a"]):
        assert memo.all(pa.array(some)) == [None if w == "c" else w.encode() for w in some]
    assert made == ["a", "b", "c", "d", "x" * 99, "x" * 99] and set(memo) == {"a", "c"}


def test_files_give_back_every_document(spark, sf):
    lib = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, ""), (3, "tie b"), (3, "tie a"), (3, "tie a")], "doc_id long, text string")
    rows = docs.unionByName(odd).collect()
    out = sorted(token_file_digests(docs.unionByName(odd), PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted([r.doc_id for r in rows], key=lambda d: (d is not None, d))
    at, want = 0, {}
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in out:
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(docs, PATH, str(tmp_path / "f"), 2, 4)
    assert read_token_files(spark, str(tmp_path / "f")).count() == 0
