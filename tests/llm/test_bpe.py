import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return bpe.Encoder(PATH), Tokenizer.from_file(PATH)


def ids(enc, text):
    return [i for part in enc.encode(text) for i in part]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeé rñß'.,!?<|>\t\n\x1c\x85\xa0ΑΣς中文のİǅ１3́😀ẞ"), max_size=60))
def test_matches_the_library(text):
    enc, lib = bpe.encoder(PATH), _lib()
    assert ids(enc, text) == lib.encode(text, add_special_tokens=False).ids


_libs = []


def _lib():
    if not _libs:
        _libs.append(Tokenizer.from_file(PATH))
    return _libs[0]


@pytest.mark.parametrize("text", ["", "  ", "don't it's", "<|endoftext|> a<|startoftext|>B <|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "नि क़ İ.", "a" * 70, "x\x1cy"])
def test_special_cases_and_decoding(pair, text):
    enc, lib = pair
    found = ids(enc, text)
    assert found == lib.encode(text, add_special_tokens=False).ids
    dec = bpe.Decoder(enc)
    assert "".join(dec.feed([i]) for i in found) + dec.finish() == lib.decode(found, skip_special_tokens=False)


def test_long_words_stream_in_bounded_windows(pair):
    _, lib = pair
    rnd = random.Random(3)
    small = bpe.Encoder(PATH, window=8)
    for text in ["".join(rnd.choice(["in", "th", "er", "e", "an", "tion", "s", "aa", "re"]) for _ in range(3000)), "a" * 9001, "ab" * 4000]:
        assert list(small.stream(text.encode())) == lib.encode(text, add_special_tokens=False).ids


def test_bytes_decode_across_tokens(pair):
    enc, _ = pair
    dec = bpe.Decoder(enc, by_bytes=True)
    found = [enc.inner[b] for b in "é😀".encode()]
    assert [dec.feed([i]) for i in found] == ["", "é", "", "", "", "😀"]


def test_query_edge_cases(spark, pair):
    enc, lib = pair
    rows = [(1, None, "x"), (2, "", "x"), (None, "Hello, wörld", "y"), (1, None, "x"), (4, "lo " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.round_trip_digests(docs, PATH).collect()
    assert len(out) == 5
    for row in out:
        text = next(t for d, t, _ in rows if d == row.doc_id) or ""
        want = lib.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0
    full = bpe.encode_documents(docs, PATH, decoded_col="decoded").filter("doc_id is null").first()
    assert full.token_ids == lib.encode("Hello, wörld", add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, PATH, ids_col="n_tokens")
