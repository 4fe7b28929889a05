"""Counts equal the libraries; the cache is used, appended to and never trusted across versions."""

import public_tokenizers
import pytest

from tidemark.llm import token_counts as tc
from tidemark.llm.common import new_folder

JSON = public_tokenizers.path("byte_bpe_50k.json")
DATA = [(1, "The quick one"), (2, "The quick one"), (3, None), (4, ""), (5, "x " * 3000), (None, "y")]


def counts(df):
    return sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def library(path, text):
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, rows, name):
    path = public_tokenizers.path(name)
    got = counts(tc.token_counts(rows(DATA, "doc_id long, text string", 3), path, new_folder(spark, "counts")))
    want = [(k or 0, len((t or "").encode()), n := library(path, t or ""), n > 1024) for k, t in DATA]
    assert got == sorted(want)


def test_only_distinct_misses_are_encoded(spark, rows):
    cache = new_folder(spark, "counts")
    docs = rows(DATA, "doc_id long, text string", 3)
    first = counts(tc.token_counts(docs, JSON, cache))
    stored = tc.read_cache(spark, cache)
    assert stored.count() == 4  # "The quick one", "", "x x ...", "y"
    more = docs.union(rows([(9, "new"), (10, "new")], "doc_id long, text string"))
    second = counts(tc.token_counts(more, JSON, cache))
    assert tc.read_cache(spark, cache).count() == 5
    assert set(first) < set(second) and len(second) == len(first) + 2


def test_stored_counts_are_used_and_versions_kept_apart(spark, rows):
    cache = new_folder(spark, "counts")
    docs = rows([(1, "The")], "doc_id long, text string")
    tc.add_misses(docs, JSON, cache)
    old = tc.read_cache(spark, cache).withColumn("n_tokens", tc.F.lit(99).cast("long"))
    other = new_folder(spark, "counts")
    old.union(old).write.parquet(other)  # stored twice, as a retried append can leave it
    assert counts(tc.token_counts(docs, JSON, other)) == [(1, 3, 99, False)]
    word = public_tokenizers.path("word_bpe_49k.json")
    assert counts(tc.token_counts(docs, word, other)) == [(1, 3, library(word, "The"), False)]


def test_special_strings_and_clashing_columns(spark, rows):
    docs = rows([(1, "a<|endoftext|>b", "x", 7)], "doc_id long, text string, content_digest string, n_tokens int")
    assert counts(tc.token_counts(docs, JSON, new_folder(spark, "counts"))) == [(1, 15, 3, False)]


def test_empty_table(spark, rows):
    assert tc.token_counts(rows([], "doc_id long, text string"), JSON, new_folder(spark, "counts")).count() == 0
