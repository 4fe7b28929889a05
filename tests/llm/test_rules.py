"""Base counts and distances equal brute force; clean text is kept, junk is not."""

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


TEXTS = [
    "",
    "one",
    "a b c a b c",
    "a a a a",
    "x\n \nx\nx\n\n\n y\x0bz\x1cq\xa0r",
    "é漢 #*$%&|<> é漢 #*$%&|<> é漢 \x0c",
    "word " * 70_000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert rules.base_counts(text) == brute_counts(text)


def test_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert rules.distance(p, p) == 0 and rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert np.isclose(rules.distance(p, q), np.sqrt((kl(p) + kl(q)) / 2))


def test_references_count_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    refs = rules.references(docs)
    table = docs.select("lang", "text").toPandas()
    for lang, texts in [*table.groupby("lang").text, ("*", table.text)]:
        classes = np.mean([rules.class_histogram(t) for t in texts], axis=0)
        assert np.allclose(refs[lang].classes, classes)
        shares = Counter()
        for t in texts:
            words = rules.plain_words(t)
            for w in words:
                shares[w] += 1 / len(words)
        top = sorted(shares.values(), reverse=True)[: rules.COMMON_WORDS]
        assert np.allclose(refs[lang].shares[:-1] * sum(shares.values()), top)


def test_query_counts_and_verdicts(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_rules"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    for k, r in got.iterrows():
        want = brute_counts(docs.text[k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    judged = both[~both.base_failed]
    assert judged[judged.quality == 1].kept.mean() >= 0.99
    assert both[both.quality == 0].kept.mean() <= 0.35


def test_odd_rows(rows):
    plain = "the cat sat on the mat and then some other words came by to fill the line up again. " * 3
    data = [(1, plain, "en", 0.0), (1, plain, "en", 1.0), (2, None, None, None), (None, "", "en", 0.0), (3, "* " * 90_000, None, 0.0)]
    got = rules.quality_rules(rows(data, "doc_id long, text string, lang string, kept double", 2)).collect()
    assert len(got) == 5
    assert {r.doc_id: r.n_words for r in got} == {1: 57, 2: 0, None: 0, 3: 90_000}
    assert all(r.base_failed and not r.kept for r in got if r.n_words != 57)
    assert rules.quality_rules(rows([], "doc_id long, text string, lang string")).count() == 0


def test_short_texts_are_not_judged():
    ref = rules.Reference(np.eye(9)[0], {}, np.array([1.0]))
    assert rules.divergences("###", ref) == (None, None)
