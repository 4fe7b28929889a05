"""Ranked search against scores computed term by term."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import ranked_search as rs


def brute(docs, items, top=50):
    """(item, rank, doc, score); docs and items are (key, text)."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(k, Counter(split(t))) for k, t in docs]
    N = sum(1 for _, c in counted if c)
    L = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        words = set(split(text))
        scored = []
        for k, c in counted:
            n = sum(c.values())
            if not n:
                continue
            m = 50 + 50 * n * N // L
            s = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c
            )
            if s > 0:
                scored.append((k, s))
        scored.sort(key=lambda x: (-x[1], x[0] is not None, x[0] if x[0] is not None else 0))
        out += [(item, r + 1, k, s) for r, (k, s) in enumerate(scored[:top])]
    return sorted(out, key=str)


def got(df, item="item_id", key="doc_id"):
    return sorted(((r[item], r["rank"], r[key], r["score"]) for r in df.collect()), key=str)


def corpus(seed, docs=600, words=150):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)] + ["É", "x9", "THE", "日本"]
    odds = [1 / (i + 1) for i in range(len(pool))]
    make = lambda n: " ".join(rng.choices(pool, odds, k=n))
    data = [(i, make(rng.choice([1, 3, 20, 200]))) for i in range(docs)]
    return data, [(i, make(rng.randint(1, 30))) for i in range(25)]


@pytest.mark.parametrize("batch,share", [(50, 1 / 32), (10_000, 1 / 2)])
def test_equals_brute_force(spark, rows, batch, share, monkeypatch):
    monkeypatch.setattr(rs, "HEAD", share)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs, items = corpus(batch)
        for top in (1, 7, 50):
            assert got(rs.search(rows(docs, "doc_id long, text string", 4), rows(items, "item_id long, text string"), top)) == brute(docs, items, top)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ties_copies_odd_keys_and_blocks(rows, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_BYTES", 300)
    big = 2**53 + 1
    docs, items = corpus(3, 200)
    docs += [(big + i, "w3 w5 w7") for i in range(700)] + [(None, "w3 w5 w7"), (None, None), (5, ""), (5, "w3 w5 w7"), (-1, "!!!")]
    docs += [(9, "w100 " * 30_000)]
    items += [(None, "w3 w7"), (7, None), (8, "..."), (8, "w3 w7"), (8, "w7 W3 w3"), (big, "nowhere")]
    df = rows([(k, t, 1, "s") for k, t in docs], "doc_id long, text string, score int, query string", 5)
    assert got(rs.search(df, rows(items, "item_id long, text string"))) == brute(docs, items)


def test_string_keys_and_empty_tables(rows):
    docs = [(f"k{i}", "a b" if i % 2 else "b c") for i in range(9)] + [(None, "a")]
    items = [("q", "a c"), (None, "b")]
    named = rs.search(rows(docs, "name string, body string"), rows(items, "item string, q string"), 4, "name", "body", "item", "q")
    assert got(named, "item", "name") == brute(docs, items, 4)
    none, some = rows([], "doc_id long, text string"), rows([(1, "a")], "item_id long, text string")
    assert rs.search(none, some).count() == 0
    empty = rs.search(rows([(1, "a")], "doc_id long, text string"), rows([], "item_id string, text string"))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"] and dict(empty.dtypes)["item_id"] == "string"


def test_buckets_are_pruned():
    """A bucket of short vectors is not looked into, and documents without heavy terms are not
    survivors."""
    import numpy as np
    import pyarrow as pa

    terms = [[0, 1, 2], [2], [2], [1, 2]]
    impacts = [[900, 900, 900], [10, ], [900], [400, 900]]
    batch = pa.record_batch({
        "k": pa.array([1, 2, 3, 4]), "terms": pa.array(terms, pa.list_(pa.int32())), "impacts": pa.array(impacts, pa.list_(pa.int32())),
        "norm": [math.hypot(*x) for x in impacts],
    })
    q = rs.Queries(["q"], [np.array([0, 1, 2])], [np.array([100, 50, 1])])
    bucket = rs.Bucket(batch, 3)
    assert bucket.survivors(q.terms[0], q.weights[0], q.tails[0], 1.0).tolist() == [0, 1, 2, 3]
    assert bucket.survivors(q.terms[0], q.weights[0], q.tails[0], 20_000.0).tolist() == [0, 3]
    assert bucket.survivors(q.terms[0], q.weights[0], q.tails[0], 60_000.0).tolist() == [0]
    searcher = rs.Searcher(q, 3, np.array([1e9]), 5)
    searcher.see(batch)
    assert searcher.best == [([], [])]
