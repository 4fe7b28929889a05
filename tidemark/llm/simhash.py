"""SimHash near-duplicates by vantage-point trees.

Every text becomes a 64-bit fingerprint of its word shingles. Equal fingerprints collapse to
one node. Pairs of nodes within ``radius`` bits are found exactly by vantage-point trees: a
vantage point cuts a set at the median distance; by the triangle bound a pair that lies
across the cut has both ends within ``radius`` of it. So a set is joined as its inner half,
its outer half, and the two boundary strips against each other, over and over.

The upper levels of this tree, built on the driver from a bounded sample, deal the nodes to
shards (Spark tasks); the lower levels run inside a shard. The sample only steers where the
cuts are; which pairs are found does not depend on it. Shards give a spanning forest of their
links instead of all pairs, and components are closed by rounds of star contraction as Spark
joins.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked like any
other; repeated rows are reported for every row; an empty table gives an empty result; a NULL
key is reported, but never names a component while another key can.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh, quoted, text_of, written

#: Fingerprints that place the upper vantage points and cuts.
SAMPLE = 8192
#: Expected fingerprints of a shard's larger side; beyond, a shard is cut again.
SHARD_ROWS = 64_000
#: Fingerprint pairs that are compared at once.
BLOCK_PAIRS = 1 << 20


# ------------------------------------------------------------------------ fingerprints


def _shingles(text: str, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles, in their order; of all words where they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(width, len(words))
    spans = zip(starts[: len(words) - w + 1].tolist(), ends[w - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64)


def _simhash(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed 64-bit integer."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str, width: int, seed: int = 42) -> int:
    """SimHash of the word shingles, as a signed 64-bit integer."""
    return _simhash(_shingles(text, width, seed))


def fingerprint_of(text: Column, width: int) -> Column:
    """Fingerprint column of a text column."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return run(text)


# ------------------------------------------------------------------- vantage-point trees


def _distances(fps: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ vantage).astype(np.int16)


def _cut(a: np.ndarray, b: np.ndarray | None, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """A vantage point of the set(s), and the median distance from it."""
    pool = a if b is None else np.concatenate([a, b])
    vantage = pool[rng.integers(len(pool))]
    return vantage, int(np.median(_distances(pool, vantage)))


class Branch:
    """An upper node: a cut, and the branches or shard numbers behind it.

    A set is cut into (inner, outer, strips); a pair of sets into (inner x inner, outer x
    outer, inner strip x outer strip, outer strip x inner strip).
    """

    def __init__(self, vantage: np.uint64, cut: int, below: list):
        self.vantage, self.cut, self.below = vantage, cut, below


def plan_shards(
    sample: np.ndarray, total: int, radius: int, shard_rows: int = SHARD_ROWS, other: np.ndarray | None = None, first: int = 0
) -> tuple[Branch | int, int]:
    """The upper levels, from a sample that stands for ``total`` fingerprints (with ``other``,
    of both sets), and the number of the next shard. A set that its cut does not make smaller
    stays whole."""
    rng = np.random.default_rng(42)
    scale = total / max(1, len(sample) + (0 if other is None else len(other)))
    shards = first

    def build(a: np.ndarray, b: np.ndarray | None):
        nonlocal shards
        size = max(len(a), 0 if b is None else len(b))
        if size * scale > shard_rows and size > 16:
            vantage, cut = _cut(a, b, rng)
            inner, outer, low, high = _sides(a, vantage, cut, radius)
            if b is None:
                parts = [(a[inner], None), (a[outer], None), (a[low], a[high])]
            else:
                b_inner, b_outer, b_low, b_high = _sides(b, vantage, cut, radius)
                parts = [(a[inner], b[b_inner]), (a[outer], b[b_outer]), (a[low], b[b_high]), (a[high], b[b_low])]
            largest = max(max(len(x), 0 if y is None else len(y)) for x, y in parts)
            if largest < 0.95 * size:
                return Branch(vantage, cut, [build(x, y) for x, y in parts])
        shards += 1
        return shards - 1

    return build(sample, other), shards


def _sides(fps: np.ndarray, vantage: np.uint64, cut: int, radius: int) -> tuple[np.ndarray, ...]:
    """Inner and outer half, and the strip of each that a link across the cut can reach."""
    d = _distances(fps, vantage)
    inner = d <= cut
    return inner, ~inner, inner & (d > cut - radius), ~inner & (d <= cut + radius)


def deal(tree: Branch | int, fps: np.ndarray, radius: int, as_side: int = 2) -> Iterator[tuple[int, int, np.ndarray]]:
    """(shard, side, positions) of every shard that must see some of ``fps``. Side 0 is a set
    or the first of a pair, side 1 the second of a pair, 2 a set joined with itself."""

    def go(node, at: np.ndarray, side: int):
        if not len(at):
            return
        if isinstance(node, int):
            yield node, side, at
            return
        inner, outer, low, high = (at[m] for m in _sides(fps[at], node.vantage, node.cut, radius))
        if side == 2:
            yield from go(node.below[0], inner, 2)
            yield from go(node.below[1], outer, 2)
            yield from go(node.below[2], low, 0)
            yield from go(node.below[2], high, 1)
        else:
            yield from go(node.below[0], inner, side)
            yield from go(node.below[1], outer, side)
            yield from go(node.below[2], low if side == 0 else high, side)
            yield from go(node.below[3], high if side == 0 else low, side)

    yield from go(tree, np.arange(len(fps)), as_side)


def _block(a: np.ndarray, b: np.ndarray, fps: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Links between positions ``a`` and ``b`` of a block; where they are many, a forest with
    the same components."""
    near = np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return np.empty((0, 2), np.int64)
    if near.sum() <= 4 * (len(a) + len(b)):
        i, j = np.nonzero(near)
        return np.stack([a[i], b[j]], axis=1)
    label_a, label_b = a.copy(), b.copy()
    while True:
        new_b = np.minimum(label_b, np.where(near, label_a[:, None], np.iinfo(np.int64).max).min(axis=0))
        new_a = np.minimum(label_a, np.where(near, new_b[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    links = np.concatenate([np.stack([a, label_a], axis=1), np.stack([b, label_b], axis=1)])
    return links[links[:, 0] != links[:, 1]]


def _join(
    a: np.ndarray, b: np.ndarray | None, fps: np.ndarray, radius: int, rng: np.random.Generator, out: list, block=_block
) -> None:
    """Links within positions ``a``, or between ``a`` and ``b``, by the lower levels."""
    if not len(a) or (b is not None and not len(b)):
        return
    other = a if b is None else b
    if len(a) * len(other) > BLOCK_PAIRS:
        vantage, cut = _cut(fps[a], None if b is None else fps[b], rng)
        inner, outer, low, high = (a[m] for m in _sides(fps[a], vantage, cut, radius))
        if b is None:
            parts = [(inner, None), (outer, None), (low, high)]
        else:
            b_inner, b_outer, b_low, b_high = (b[m] for m in _sides(fps[b], vantage, cut, radius))
            parts = [(inner, b_inner), (outer, b_outer), (low, b_high), (high, b_low)]
        work = sum(len(x) * len(x if y is None else y) for x, y in parts)
        if work < 0.98 * len(a) * len(other):
            for x, y in parts:
                _join(x, y, fps, radius, rng, out, block)
            return
    step = max(1, BLOCK_PAIRS // len(other))
    for k in range(0, len(a), step):
        rows = a[k : k + step]
        if b is None:
            out.append(block(rows, rows, fps, radius, True))
            rest = a[k + step :]
        else:
            rest = b
        for j in range(0, len(rest), max(1, BLOCK_PAIRS // len(rows))):
            out.append(block(rows, rest[j : j + max(1, BLOCK_PAIRS // len(rows))], fps, radius, False))


def _forest(links: np.ndarray) -> np.ndarray:
    """A spanning forest: each position with the smallest of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for x, y in links.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in parent]
    return np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)


def shard_links(fps: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """A forest over the links of one shard, as pairs of fingerprints."""
    found: list[np.ndarray] = []
    rng = np.random.default_rng(zlib.crc32(fps.tobytes()))
    bits = fps.view(np.uint64)
    own = np.flatnonzero(side == 2)
    _join(own, None, bits, radius, rng, found)
    _join(np.flatnonzero(side == 0), np.flatnonzero(side == 1), bits, radius, rng, found)
    links = [x for x in found if len(x)]
    if not links:
        return np.empty((0, 2), np.int64)
    return fps[_forest(np.unique(np.sort(np.concatenate(links), axis=1), axis=0))]


# --------------------------------------------------------------------------- components


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for links ``a``-``b``.

    Alternates large-star and small-star contraction: every node tells its larger (then its
    smaller) neighbours of the smallest one, which shortens chains by half in each round.
    """
    edges = checkpointed(links.where("a <> b").select("a", "b").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        edges = checkpointed(small.where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def link_fingerprints(nodes: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` within ``radius`` bits, as a
    forest for each shard."""
    total = nodes.count()
    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= share).select("fp").limit(4 * SAMPLE).collect()
    bits = np.sort(np.array([r.fp for r in sample], np.int64)).view(np.uint64)
    tree, shards = plan_shards(bits, total, radius, shard_rows)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for shard, side, at in deal(tree, fps.view(np.uint64), radius):
                yield pd.DataFrame({"shard": shard, "side": side, "fp": fps[at]})

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(shard_links(rows["fp"].to_numpy(np.int64), rows["side"].to_numpy(), radius), columns=["a", "b"])

    dealt = nodes.select("fp").mapInPandas(spread, "shard int, side int, fp long")
    return dealt.repartition(max(1, shards), "shard").groupBy("shard").applyInPandas(find, "a long, b long")


def _labels(prints: DataFrame, key: str, radius: int, shard_rows: int) -> DataFrame:
    """``fp`` and ``component_id`` for every fingerprint of ``prints``."""
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-nodes")
    closed = components(link_fingerprints(nodes, radius, shard_rows))
    placed = nodes.join(closed.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(named, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    radius: int = 4,
    key: str = "doc_id",
    text: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest key that links of at most ``radius`` bits reach."""
    prints = written(docs.select(F.col(key), fingerprint_of(text_of(text), width).alias("fp")), "fingerprints")
    return prints.join(_labels(prints, key, radius, shard_rows), "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    width: int = 4,
    radius: int = 4,
    key: str = "doc_id",
    text: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the
    smallest key stays, unchanged. Rows that repeat that key collapse to one; of a component
    without any key one row stays.

    The rows are written once with a number; one number for each component is picked among
    narrow rows, and the written rows are read again to keep those.
    """
    number = fresh(docs, "_row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-documents")
    prints = written(
        rows.select(F.col(key).alias("k"), F.col(number).alias("r"), fingerprint_of(text_of(text), width).alias("fp")),
        "fingerprints",
    )
    labels = _labels(prints, "k", radius, shard_rows)
    # Smallest key first, NULL keys last, then the first row.
    of_print = prints.groupBy("fp").agg(F.min(F.struct(F.col("k").isNull().alias("n"), "k", "r")).alias("best"))
    root = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    best = of_print.join(labels, "fp").groupBy(root.alias("root")).agg(F.min("best").alias("best"))
    kept = best.select(F.col("best.r").alias(number))
    return rows.join(kept, number, "left_semi").select(*map(quoted, docs.columns))
