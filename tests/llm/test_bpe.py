"""Encoding equals the tokenizers library; decoding equals its decode and gives the text back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("'sstreveldm  \n\t\r  ab12!?#é漢字") + ["Ᲊ", "́", "<|endoftext|>", "\U0001f600", "\x85", "\x1c", " 's", "'ll"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    mixed = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(3000)]
    return mixed + ["", "a" * 5000, "ab" * 3000 + " " * 700, " " * 1000, "é!" * 2000, "'" * 100, "x'sx'll 'd", "\n\nA", "a b"]


def test_ids_and_text_equal_the_library(library):
    encoder = bpe.encoder(PATH)
    for text, ids in zip(texts(), encoder.encode_all(texts())):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_words_rejoin_and_long_words_use_the_same_merges(library):
    for text in texts():
        assert "".join(w for part in bpe.words_of(text) for w in part) == text
    encoder = bpe.encoder(PATH)
    for word in ("abcdefgh" * 8, "thethethe", "éèê" * 10):
        assert encoder._encode_long(word.encode()) == encoder._encode_rows([word.encode()])[0]


def test_broken_bytes_decode_to_replacements():
    encoder = bpe.encoder(PATH)
    half = np.array([encoder.byte_id["é".encode()[0]]], "<u4").tobytes()
    assert encoder.decode(half) == "�"


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.RankArrayBPE(public_tokenizers.path("word_bpe_49k.json"))


def test_operator_on_odd_rows(rows):
    data = [(1, "The the", "x"), (1, "The the", "y"), (2, None, "z"), (None, "", "w"), (3, "a" * 300_000, "v")]
    got = bpe.encode_decode(rows(data, "doc_id long, text string, n_tokens string", 2), PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[:4] == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert {r.ids_sha256 for r in got if not r.n_tokens} == {empty}
    assert [r.decoded_sha256 for r in got if r.doc_id == 3] == [hashlib.sha256(b"a" * 300_000).hexdigest()]
    assert bpe.encode_decode(rows([], "doc_id long, text string"), PATH).count() == 0


def test_ids_round_trip_through_columns(rows):
    docs = rows([(1, "Über <|endoftext|> x"), (2, None)], "doc_id long, text string")
    got = bpe.decode_ids(bpe.encode_decode(docs, PATH, with_ids=True).drop("decoded"), PATH)
    assert {r.doc_id: r.decoded for r in got.collect()} == {1: "Über <|endoftext|> x", 2: ""}


def test_query_equals_the_library(spark, library):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op2_bpe_encode_decode"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(library.encode(d.text, add_special_tokens=False).ids, "<u4")
        r = got.pop(d.doc_id)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
    assert not got
