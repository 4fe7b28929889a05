"""Recall of the candidates, exact edits, and the defined results on odd input."""

import random

import pytest

from tidemark.llm import decontaminate as dc

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]


@pytest.fixture(scope="module")
def hosts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect()
    return [d.text[:900] for d in docs]


def least_edits(item, words):
    """Smallest word edit distance of the item to any window, by the whole table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def edited(words, share, rng):
    out, at = [], set(rng.sample(range(len(words)), round(share * len(words))))
    for i, w in enumerate(words):
        kind = rng.choice("sdi") if i in at else ""
        out += {"s": [rng.choice(words)], "d": [], "i": [w, rng.choice(words)]}.get(kind, [w])
    return out


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.05, 1.0), (0.1, 0.98), (0.18, 0.95)])
def test_recall(items, hosts, share, least):
    rng = random.Random(int(share * 100))
    matcher = dc.Matcher(items)
    texts, want = [], []
    for item_id, text in items:
        host, passage = rng.choice(hosts).split(), edited(dc.words_of(text), share, rng)
        at = rng.randint(0, len(host))
        texts.append(" ".join([*host[:at], *[w.decode() for w in passage], *host[at:]]))
        want.append(item_id)
    found = [k in {hit[0] for hit in hits} for k, hits in zip(want, matcher.match(texts))]
    assert sum(found) / len(found) >= least


def test_reported_edits_are_exact_and_clean_documents_stay(items, hosts):
    rng = random.Random(9)
    matcher = dc.Matcher(items)
    by_id = dict(items)
    texts = [h + " " + b" ".join(edited(dc.words_of(t), 0.12, rng)).decode() for h, (_, t) in zip(hosts, items)]
    for text, hits in zip(texts, matcher.match(texts)):
        for k, edits, n in hits:
            item = dc.words_of(by_id[k])
            assert len(item) == n and edits == least_edits(item, dc.words_of(text)) <= 0.2 * n
    half = [b" ".join(dc.words_of(t)[: len(dc.words_of(t)) // 2]).decode() for _, t in items]
    for text, hits in zip(half, matcher.match(half)):
        for k, edits, n in hits:
            assert edits == least_edits(dc.words_of(by_id[k]), dc.words_of(text)) <= 0.2 * n


def test_query_finds_every_exact_passage(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id): r.n_edits for r in QUERIES["op6_benchmark_decontamination"](spark, sf).collect()}
    assert exact and exact == {k for k, e in got.items() if e == 0}
    for doc in docs[:150]:  # brute force over whole texts
        words = dc.words_of(doc.text)
        for i in items:
            item = dc.words_of(i.text)
            near = least_edits(item, words) if len(words) < 400 else None
            if near is not None and near <= 0.2 * len(item):
                assert got[doc.doc_id, i.item_id] == near


def test_odd_rows(rows, spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    docs = rows(
        [(1, f"x y {passage} z", 1), (1, f"x y {passage} z", 2), (2, None, 3), (3, "", 4), (None, passage.upper() + "!", 5), (4, "q " * 60_000 + passage, 6)],
        "doc_id long, text string, item_id int",
        3,
    )
    items = rows([(10, passage), (11, passage), (12, None), (13, ""), (14, "too short"), (None, passage)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.n_edits) for r in dc.leaks(docs, items).collect())
    want = [(d, i, 0) for d in (0, 1, 1, 4) for i in (0, 10, 11)]
    assert got == sorted(want)
    clean = dc.without_leaks(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]


def test_blocks_of_items_together_find_all(rows, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(7)]
    docs = rows([(i, "start " + t + " end") for i, t in items], "doc_id long, text string")
    bench = rows(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()) == [(i, i) for i in range(7)]
    assert dc.without_leaks(docs, bench).count() == 0


def test_empty_tables(rows):
    docs, items = rows([], "doc_id long, text string"), rows([], "item_id long, text string")
    full = rows([(1, "a b c d e f g h")], "doc_id long, text string")
    assert dc.leaks(docs, items).count() == dc.leaks(full, items).count() == 0
    assert dc.without_leaks(full, items).count() == 1
