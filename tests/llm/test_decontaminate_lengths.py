"""Recall at the promised limit for each length of an item, wherever the edits lie."""

import random

import pytest

from test_decontaminate import hosts, items  # noqa: F401
from tidemark.llm import decontaminate as dc


def found(items, hosts, places, seed):
    """By item: whether it is found with int(0.2 n) words replaced."""
    rng = random.Random(seed)
    texts = []
    for _, text in items:
        words = [w.decode() for w in dc.words_of(text)]
        n = len(words)
        edits = n // 5
        at = [(j + 1) * (n + 1) // (edits + 1) - 1 for j in range(edits)] if places == "even" else rng.sample(range(n), edits)
        for i in at:
            words[i] = f"zq{rng.randrange(10**6)}"
        host = rng.choice(hosts).split()
        cut = rng.randint(0, len(host))
        texts.append(" ".join(host[:cut] + words + host[cut:]))
    return [k in {hit[0] for hit in hits} for (k, _), hits in zip(items, dc.Matcher(items).match(texts))]


@pytest.mark.parametrize("places", ["even", "random"])
@pytest.mark.parametrize("words", [5, 6, 8, 10, 11, 12, 15, 20, 25, 60])
def test_recall_at_the_limit(items, hosts, words, places):  # noqa: F811
    short = {b" ".join(dc.words_of(t)[:words]).decode(): k for k, t in items}
    got = found([(k, t) for t, k in short.items()], hosts, places, words)
    assert sum(got) / len(got) >= 0.98


def test_a_short_item_does_not_change_the_walks_of_others(items):  # noqa: F811
    alone, mixed = dc.Matcher(items), dc.Matcher([*items, (-1, "one two three four five")])
    for a, b in zip(alone.repetitions, mixed.repetitions):
        assert a.steps == b.steps and (a.keys == b.keys).all() and (a.offset == b.offset).all()
