"""Held-out accuracy, ordered thresholds, and the defined results on odd input."""

import numpy as np
import pytest

from tidemark.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.join(quality.graded(spark.read.parquet(f"{SF}/labels.parquet")), "doc_id").orderBy("doc_id").toPandas()


@pytest.fixture(scope="module")
def halves(labelled):
    rows = [quality.features(t) for t in labelled.text]
    grades = labelled.grade.to_numpy()
    return quality.fit(rows[::2], grades[::2]), labelled[1::2]


def test_held_out_accuracy(halves):
    model, rest = halves
    tails = np.array([model.tails(t) for t in rest.text])
    good = rest.grade.to_numpy() >= 1
    kept = tails[:, 0] >= 0.5
    assert kept[good].mean() >= 0.99 and (~kept)[~good].mean() >= 0.95
    assert ((tails[:, 0] + tails[:, 1])[good].mean()) > ((tails[:, 0] + tails[:, 1])[~good].mean()) + 0.8


def test_thresholds_are_ordered_and_tails_fall(halves):
    model, rest = halves
    assert (np.diff(model.thresholds) > 0).all()
    assert all((np.diff(model.tails(t)) <= 0).all() for t in rest.text[:50])


def test_gradient_descends_to_the_shares():
    one = (np.array([7]), np.array([0.0]))
    grades = np.array([0] * 20 + [1] * 30 + [2] * 50)
    model = quality.fit([one] * 100, grades, steps=1500)
    assert np.allclose(quality._sigmoid(-model.thresholds), [0.8, 0.5], atol=0.02)


def test_grades_of_repeated_and_missing_labels(rows):
    labels = rows(
        [(1, 1, 0), (1, 0, 0), (2, 1, 1), (2, 1, None), (3, None, 1), (4, 1, None), (None, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    assert {r.doc_id: r.grade for r in quality.graded(labels).collect()} == {1: 0, 2: 1, 4: 2}


def test_no_labels_keep_everything(rows):
    docs = rows([(1, "a"), (2, None), (2, None), (None, "")], "doc_id long, text string")
    model = quality.train(docs, rows([], "doc_id long, quality int, toxic int"))
    got = quality.score(docs, model).collect()
    assert len(got) == 4 and all(r.kept and r.p_good is None for r in got)


def test_one_grade_only_and_odd_texts(rows):
    docs = rows([(1, "fine words here", 5), (2, None, 6), (3, "w " * 60_000, 7), (3, "w " * 60_000, 8)], "doc_id long, text string, kept int")
    labels = rows([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 4 and all(r.kept and 0 <= r.p_clean <= r.p_good <= 1 for r in got)
    kept = quality.score(docs, quality.train(docs, labels), only_kept=True)
    assert kept.columns == docs.columns and kept.count() == 4


def test_sample_is_bounded_and_repeatable(rows):
    docs = rows([(i, f"text {i} " * 20) for i in range(60)], "doc_id long, text string", 4)
    labels = rows([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int", 3)
    a, b = (quality.train(docs, labels, max_labelled=30) for _ in range(2))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_empty_documents(rows):
    docs = rows([], "doc_id long, text string")
    assert quality.score(docs, quality.train(docs, rows([(1, 1, 0)], "doc_id long, quality int, toxic int"))).count() == 0
