"""Every stage of the pipeline against a brute-force version of its decision."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from test_decontaminate import least_edits
from test_secret_scan import brute_spans
from test_simhash import brute_components, brute_print
from tidemark.llm import decontaminate as dc
from tidemark.llm import quality
from tidemark.llm.common import read, written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first and after each stage."""
    docs = read(spark, SF, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append((docs.columns, docs.collect()))
    return out


def test_stages_return_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier",
        "simhash_near_duplicates",
        "benchmark_decontamination",
        "secret_scan",
        "bpe_encoding",
    ]
    assert all(columns == COLUMNS for columns, _ in stages[1:-1])


def test_quality_keeps_what_the_model_keeps(spark, stages):
    docs = read(spark, SF, "documents")
    labels = read(spark, SF, "labels")
    model = quality.train(docs, labels)
    want = {d.doc_id for d in stages[0] if model.tails(d.text)[0] >= 0.5}
    assert sorted(stages[1][1]) == sorted(d for d in stages[0] if d.doc_id in want)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    known = {r.doc_id for r in labels.collect()}
    assert len(good & want) >= 0.97 * len(good) and len(want & known - good) <= 0.2 * len(known - good)


def test_one_document_of_each_group_stays(stages):
    before = stages[1][1]
    prints = [(d.doc_id, brute_print(d.text)) for d in before]
    first = {c for c in brute_components(prints)}
    assert sorted(stages[2][1]) == sorted(d for d in before if d.doc_id in first)


def test_leaking_documents_go(spark, stages):
    items = [dc.words_of(r.text) for r in read(spark, SF, "benchmark").collect()]
    kept = {d.doc_id for d in stages[3][1]}
    for d in stages[2][1]:
        words = dc.words_of(d.text)
        if len(words) > 1500:
            continue
        near = any(least_edits(i, words) <= 0.2 * len(i) for i in items if set(i) & set(words))
        assert near == (d.doc_id not in kept)
    assert sorted(stages[3][1]) == sorted(d for d in stages[2][1] if d.doc_id in kept)


def test_secrets_are_replaced_and_clean_rows_unchanged(stages):
    after = {d.doc_id: d for d in stages[4][1]}
    assert len(after) == len(stages[3][1])
    for d in stages[3][1]:
        if brute_spans(d.text):
            assert not brute_spans(after[d.doc_id].text) and "[SECRET]" in after[d.doc_id].text
            assert after[d.doc_id].n_chars == len(after[d.doc_id].text)
        else:
            assert after[d.doc_id] == d


def test_encoding_of_what_is_left(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in stages[5][1]}
    assert len(got) == len(stages[4][1])
    for d in stages[4][1]:
        ids = np.array(library.encode(d.text, add_special_tokens=False).ids, "<u4")
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[5][1])
