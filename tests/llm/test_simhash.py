"""Fingerprints and components equal brute force; trees lose no link at any depth."""

import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, width=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    w = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + w]).encode(), 42) for i in range(len(words) - w + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """Smallest key of each row's component; ``prints`` are (key, fingerprint)."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    keys = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            keys[root(i)] = min(keys.get(root(i), k), k)
    return [keys.get(root(i)) for i in range(len(prints))]


TEXTS = [
    (5, "One two three four five six seven"),
    (3, "one TWO three four five six seven"),
    (8, None),
    (9, ""),
    (2, " \t\n"),
    (7, "one two"),
    (7, "one two"),
    (None, "one two"),
    (11, "É é   x y z"),
    (12, "word " * 50_000),
]


def test_small_table_equals_brute_force(rows):
    docs = rows([(k, t, 1) for k, t in TEXTS], "doc_id long, text string, fp int", 3)
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(k, brute_print(t)) for k, t in TEXTS]
    want = [(k or 0, f"{p:016x}", c) for (k, p), c in zip(prints, brute_components(prints))]
    assert got == sorted(want)


def test_query_equals_brute_force(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d.doc_id, brute_print(d.text)) for d in docs if len(d.text) < 5000]
    got = {r.doc_id: r for r in QUERIES["op5_simhash_near_duplicates"](spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[k].fingerprint == f"{p:016x}" for k, p in prints)
    every = [(k, int(r.fingerprint, 16)) for k, r in got.items()]
    assert [r.component_id for r in got.values()] == brute_components(every)


def near_sets(n, seed):
    """Random fingerprints, chains of near ones, and a dense ball."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    parts = [base]
    for flips in (1, 2, 4):
        x = base[: n // 4].copy()
        for _ in range(flips):
            x ^= np.int64(1) << rng.integers(0, 63, len(x))
        parts.append(x)
    ball = np.repeat(base[:1], n)
    for _ in range(2):
        ball ^= np.int64(1) << rng.integers(0, 63, n)
    return np.unique(np.concatenate([*parts, ball]))


def forest_labels(links, fps):
    at = np.searchsorted(fps, links)
    return dict(map(tuple, simhash._forest(np.sort(at, axis=1)).tolist()))


@pytest.mark.parametrize("shard_rows", [60, 500, 10**6])
def test_shards_and_trees_lose_no_link(shard_rows, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 1 << 12)
    fps = near_sets(600, shard_rows)
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 4
    i, j = np.nonzero(np.triu(near, 1))
    tree, _ = simhash.plan_shards(fps[::3].view(np.uint64), len(fps), 4, shard_rows)
    dealt = {}
    for shard, side, at in simhash.deal(tree, fps.view(np.uint64), 4):
        dealt.setdefault(shard, []).append((side, at))
    links = []
    for parts in dealt.values():
        values = np.concatenate([fps[at] for _, at in parts])
        sides = np.concatenate([np.full(len(at), side) for side, at in parts])
        links.append(simhash.shard_links(values, sides, 4))
    assert forest_labels(np.concatenate(links), fps) == forest_labels(np.stack([fps[i], fps[j]], axis=1), fps)


def test_many_shards_on_spark(spark, monkeypatch):
    fps = near_sets(300, 5)
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(4)
    links = simhash.link_fingerprints(nodes, 4, shard_rows=100)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    labels = brute_components([(int(f), int(np.int64(f).view(np.uint64))) for f in fps])
    want = {int(f): c for f, c in zip(fps, labels) if labels.count(c) > 1 and c != f}
    assert {k: v for k, v in got.items() if k != v} == want


def test_long_chain_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)}


def test_empty_table(rows):
    assert simhash.near_duplicates(rows([], "doc_id long, text string")).count() == 0
    assert simhash.keep_first(rows([], "doc_id long, text string, _row int")).count() == 0


def test_keep_first_keeps_rows_whole(rows):
    docs = rows([(k, t, i) for i, (k, t) in enumerate(TEXTS)], "doc_id long, text string, _row int", 3)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert len(got) == kept.count()
    assert got == {(3, TEXTS[1][1]), (2, TEXTS[4][1]), (7, "one two"), (11, TEXTS[8][1]), (12, TEXTS[9][1])}
