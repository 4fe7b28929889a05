"""Languages are judged by their own reference or not at all, however many there are."""

import random

import pytest

from tidemark.llm import common, rules


def prose(lang, seed, words=160):
    rng = random.Random(f"{lang} {seed}")
    return " ".join(f"{lang}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(8))}" for _ in range(words))


def judged(docs):
    return {r.doc_id: r for r in rules.quality_rules(docs).collect()}


def test_rare_language_is_kept_by_the_base_rules(rows):
    data = [(k, prose("aa", k), "aa") for k in range(rules.MIN_DOCUMENTS)] + [(1000 + k, prose("zz", k), "zz") for k in range(9)]
    data += [(2000, "zz " * 200, "zz")]
    got = judged(rows(data, "doc_id long, text string, lang string", 3))
    assert all(got[k].word_distance is not None for k in range(rules.MIN_DOCUMENTS))
    rare = [got[1000 + k] for k in range(9)]
    assert all(r.kept and r.class_distance is None and r.word_distance is None for r in rare)
    assert not got[2000].kept


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, 0])
def test_every_language_has_its_own_reference(rows, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(rules, "MIN_DOCUMENTS", 2)
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(520)]
    data = [(2 * i + k, prose(n, k), n) for i, n in enumerate(names) for k in range(2)]
    data += [(5000, prose("other", 1), names[0]), (5001, prose("rare", 1), None)]
    got = judged(rows(data, "doc_id long, text string, lang string", 3))
    assert len(got) == len(data)
    assert all(got[k].kept and got[k].word_distance is not None for k in range(1040))
    assert got[5001].kept and got[5001].word_distance is None
