"""Ranked lexical search by norm buckets (after LEMP).

A document is a vector of impacts over the queries' terms, a query a vector of term weights,
the score their inner product. The documents' vectors are ordered by length (Euclidean norm,
longest first) and cut into buckets of consecutive lengths; a bucket is an Arrow batch of the
ordered table. For a query whose 50th best score so far is ``t``:

- Cauchy-Schwarz: a bucket whose longest vector times the query's length is below ``t`` holds
  no result and is skipped, and with it all that follow; the least such length over all
  queries is a filter on the ordered table, which Parquet statistics prune before reading;
- coordinate bounds: inside a bucket every term's largest impact bounds what the terms not
  yet read can add, as does Cauchy-Schwarz on the rests of both vectors; documents that cannot
  reach ``t`` are dropped as terms are read, heaviest first, and documents that hold none of
  the terms read before the bound falls below ``t`` are never touched;
- survivors are rescored in 64-bit integers, and only these scores decide.

The first ``t`` of each query is the 50th score among the longest vectors; later every task
raises its own. A task returns its best documents of each query, the final ranks are a window
over those. The bounds only say what need not be looked at: results are exact.

A block of queries and its terms (``BLOCK_BYTES`` of text) is broadcast; the documents are
read once for each block. Ties in length are spread by a number of the row, so that copies of
one document fill many buckets.

Defined results: a NULL text has no terms and is no document of the statistics, a NULL or
term-free item finds nothing; every row of ``items`` is a query of its own, also where ids or
texts repeat; every row of ``docs`` is a document, repeated rows are ranked side by side; equal
scores stand by ascending key, NULL first; texts of any length count whole; empty tables give
an empty result. Other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_keeping, maybe_broadcast, text_of, written

#: Maximal runs that are terms; as Java and Python read it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_TERM = re.compile(TERM)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Text of the queries that are broadcast at once.
BLOCK_BYTES = 8 << 20

#: Share of the longest vectors that give the first thresholds.
HEAD = 1 / 32

#: Vectors of one sorted partition of the index.
PARTITION_ROWS = 200_000

#: Bounds are floats: widened so that rounding never drops a result.
_SLACK = 1 + 1e-9


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.translate(_LOWER))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds per unit of weight, in integers."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The length normalisation of documents of ``n`` terms."""
    return 100 - 50 + (50 * n * docs) // total


def weight_of(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# -------------------------------------------------------------------------------- queries


@dataclass
class Queries:
    """The queries of a block: term numbers, heaviest first, and their weights."""

    names: list[str]
    terms: list[np.ndarray]
    weights: list[np.ndarray]

    def __post_init__(self):
        self.tails = []  # length of what follows each place
        for w in self.weights:
            rest = np.sqrt(np.cumsum((w.astype(float) ** 2)[::-1])[::-1])
            self.tails.append(np.append(rest, 0.0))


def _queries(block: list, vocabulary: dict[str, int], weights: dict[int, int]) -> Queries:
    names, terms, own = [], [], []
    for row in block:
        at = np.array([vocabulary[t] for t in row["terms"]], np.int64)
        w = np.array([weights.get(t, 0) for t in at], np.int64)
        keep = np.argsort(-w, kind="stable")[: np.count_nonzero(w > 0)]
        names.append(row["query"])
        terms.append(at[keep])
        own.append(w[keep])
    return Queries(names, terms, own)


def _query_table(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Items with the name of their query, and the different queries with their terms."""

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(terms_of(t))))

    named = items.select(F.col(key).alias("item"), terms(text_of(text)).alias("terms")).where(F.size("terms") > 0)
    named = written(named.withColumn("query", F.sha2(F.array_join("terms", " "), 256)), "search-items")
    queries = named.groupBy("query").agg(F.first("terms").alias("terms"))
    return named.select("item", "query"), written(queries, "search-queries")


# ---------------------------------------------------------------------------------- index


def _vectors(docs: DataFrame, key: str, text: str, held) -> DataFrame:
    """Counts of the block's terms in each document: ``k``, ``n`` (all terms), ``terms`` and
    ``tfs``; rows without terms stay, as they count in no statistic but are cheap."""

    def work(batch: pd.DataFrame) -> dict[str, list]:
        known = held.value
        out: dict[str, list] = {"n": [], "terms": [], "tfs": []}
        for text in batch["_text"]:
            found = terms_of(text)
            own = [(known[t], c) for t, c in Counter(found).items() if t in known]
            out["n"].append(len(found))
            out["terms"].append(np.array([t for t, _ in own], np.int32))
            out["tfs"].append(np.array([c for _, c in own], np.int64))
        return out

    narrow = docs.select(F.col(key).alias("k"), text_of(text).alias("_text"))
    return written(map_keeping(narrow, ["k"], work, "n long, terms array<int>, tfs array<long>"), "search-vectors")


def _index(vectors: DataFrame, docs: int, total: int) -> DataFrame:
    """Impact vectors ordered by length, longest first."""

    def work(batch: pd.DataFrame) -> dict[str, list]:
        m = length_factor(batch["n"].to_numpy(np.int64), docs, total)
        made = [impacts(np.asarray(tf, np.int64), x) for tf, x in zip(batch["tfs"], m)]
        return {"impacts": [x.astype(np.int32) for x in made], "norm": [math.sqrt(float((x.astype(float) ** 2).sum())) for x in made]}

    rows = vectors.where(F.size("terms") > 0).withColumn("slot", F.monotonically_increasing_id())
    made = map_keeping(rows.select("k", "slot", "terms", "n", "tfs"), ["k", "slot", "terms"], work, "impacts array<int>, norm double")
    n = docs  # at least as many as there are vectors
    parts = max(-(-n // PARTITION_ROWS), 2 * made.sparkSession.sparkContext.defaultParallelism)
    # Equal lengths lie apart by their row's number, so copies fill more than one partition.
    ordered = made.repartitionByRange(parts, F.col("norm").desc(), "slot").sortWithinPartitions(F.col("norm").desc(), "slot")
    return written(ordered.drop("slot"), "search-index")


# --------------------------------------------------------------------------------- search


class Bucket:
    """Consecutive vectors of the index, and the places of each term in them."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: int):
        flat = batch.column("terms")
        ends = flat.offsets.to_numpy() - flat.offsets[0].as_py()
        self.starts, self.lengths = ends[:-1], np.diff(ends)
        self.terms = flat.flatten().to_numpy()
        self.impacts = batch.column("impacts").flatten().to_numpy().astype(np.int64)
        self.norms = batch.column("norm").to_numpy()
        self.longest = float(self.norms.max()) if len(self.norms) else 0.0
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        order = np.argsort(self.terms, kind="stable")
        self.owner, self.of_term = owner[order], self.impacts[order]
        counts = np.bincount(self.terms, minlength=vocabulary)
        self.at = np.append(0, np.cumsum(counts))
        self.caps = np.zeros(vocabulary)
        there = counts > 0
        self.caps[there] = np.maximum.reduceat(self.of_term, self.at[:-1][there]) if there.any() else 0.0

    def places(self, term: int) -> slice:
        return slice(self.at[term], self.at[term + 1])

    def survivors(self, terms: np.ndarray, weights: np.ndarray, tails: np.ndarray, least: float) -> np.ndarray:
        """Documents that may score ``least`` or more."""
        caps = weights * self.caps[terms]
        rest = np.append(np.cumsum(caps[::-1])[::-1], 0.0) * _SLACK  # what the terms from a place on can add
        score = np.zeros(len(self.norms))
        squares = np.zeros(len(self.norms))
        alive = np.zeros(len(self.norms), bool)
        reads = self.at[terms + 1] - self.at[terms]
        unread = np.cumsum(reads[::-1])[::-1]
        width = len(self.terms) / max(1, len(self.norms))
        for j, (t, w) in enumerate(zip(terms, weights)):
            if rest[j] < least:  # a document first met from here on cannot reach the threshold
                bound = np.minimum(rest[j], tails[j] * np.sqrt(np.maximum(self.norms**2 * _SLACK - squares, 0.0)))
                alive &= (score + bound) * _SLACK >= least
                if np.count_nonzero(alive) * width <= unread[j]:  # rescoring them costs less than reading on
                    return np.flatnonzero(alive)
            here = self.places(t)
            docs, own = self.owner[here], self.of_term[here].astype(float)
            score[docs] += w * own
            squares[docs] += own**2
            if rest[j] >= least:
                alive[docs] = True
        alive &= score * _SLACK >= least
        return np.flatnonzero(alive)

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of documents, by a table of weights."""
        lengths = self.lengths[docs]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - lengths), lengths)
        return np.add.reduceat(dense[self.terms[at]] * self.impacts[at], ends - lengths) if len(at) else np.zeros(0, np.int64)


def _order(scores: list[int], keys: list) -> list[int]:
    """Places by descending score, then ascending key, NULL first."""
    return sorted(range(len(keys)), key=lambda i: (-scores[i], keys[i] is not None, keys[i] if keys[i] is not None else 0))


class Searcher:
    """The best documents of each query over the buckets of a task."""

    def __init__(self, queries: Queries, vocabulary: int, thresholds: np.ndarray, top: int):
        self.queries, self.vocabulary, self.top = queries, vocabulary, top
        self.least = thresholds.astype(float)
        self.best: list[tuple[list[int], list]] = [([], []) for _ in queries.names]
        self.dense = np.zeros(vocabulary, np.int64)

    def see(self, batch: pa.RecordBatch) -> None:
        bucket = Bucket(batch, self.vocabulary)
        keys = batch.column("k")
        for q, (terms, weights, tails) in enumerate(zip(self.queries.terms, self.queries.weights, self.queries.tails)):
            least = max(self.least[q], 1.0)
            if not len(terms) or bucket.longest * tails[0] * _SLACK < least:
                continue
            docs = bucket.survivors(terms, weights, tails, least)
            if not len(docs):
                continue
            self.dense[terms] = weights
            scores = bucket.scores(docs, self.dense)
            self.dense[terms] = 0
            if len(scores) > self.top:  # all that tie with the last place stay for now
                least = max(least, np.partition(scores, -self.top)[-self.top])
            keep = scores >= least
            self._add(q, scores[keep], keys.take(pa.array(docs[keep])))

    def _add(self, q: int, scores: np.ndarray, keys: pa.Array) -> None:
        if len(scores) > 4 * self.top:  # many ties: the first keys of each score are enough
            order = pc.sort_indices(
                pa.table({"s": scores, "k": keys}), sort_keys=[("s", "descending"), ("k", "ascending")], null_placement="at_start"
            )[: self.top]
            scores, keys = scores[order.to_numpy()], keys.take(order)
        old, held = self.best[q]
        old, held = old + scores.tolist(), held + keys.to_pylist()
        order = _order(old, held)[: self.top]
        self.best[q] = [old[i] for i in order], [held[i] for i in order]
        if len(order) == self.top:
            self.least[q] = max(self.least[q], self.best[q][0][-1])

    def rows(self) -> Iterator[tuple[str, int, object]]:
        for name, (scores, keys) in zip(self.queries.names, self.best):
            yield from ((name, s, k) for s, k in zip(scores, keys))


def _found(index: DataFrame, queries, vocabulary: int, thresholds, top: int) -> DataFrame:
    """The best rows of each task: ``query``, ``score`` and ``k``."""
    kind = index.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, key_type = Searcher(queries.value, vocabulary, thresholds.value, top), None
        for batch in batches:
            key_type = batch.schema.field("k").type
            if batch.num_rows:
                searcher.see(batch)
        if key_type is not None:
            rows = list(searcher.rows())
            names, scores, keys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.int64()), pa.array(keys, key_type)], names=["query", "score", "k"]
            )

    return index.mapInArrow(run, f"query string, score long, k {kind.simpleString()}")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("k").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: list, key: str, text: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for row in block for t in row["terms"]}))}
    vectors = _vectors(docs, key, text, spark.sparkContext.broadcast(vocabulary))
    n, total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # the block's terms
    weights = {r["t"]: weight_of(r["df"], n) for r in held}
    queries = spark.sparkContext.broadcast(_queries(block, vocabulary, weights))
    index = _index(vectors, n, total)
    none = np.zeros(len(block))
    # Thresholds from the longest vectors; one number for each query comes back.
    cut = index.agg(F.percentile_approx("norm", F.lit(1 - HEAD), F.lit(1000))).first()[0] or 0.0
    head = _ranked(_found(index.where(F.col("norm") >= cut), queries, len(vocabulary), spark.sparkContext.broadcast(none), top), top)
    place = {name: i for i, name in enumerate(queries.value.names)}
    least = none.copy()
    for row in head.where(F.col("rank") == top).select("query", "score").collect():
        least[place[row["query"]]] = row["score"]
    # No vector shorter than this can hold a result of any query.
    shortest = min((max(t, 1.0) / tails[0] for t, tails in zip(least, queries.value.tails) if tails[0] > 0), default=0.0) / _SLACK
    found = _found(index.where(F.col("norm") >= shortest), queries, len(vocabulary), spark.sparkContext.broadcast(least), top)
    return written(_ranked(found, top), "search-results")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 50,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``top`` best documents of each row of ``items``: ``item_id``, ``rank``, ``doc_id``
    and ``score``, under the names of ``item_key`` and ``key``."""
    named, queries = _query_table(items, item_key, item_text)
    size = F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 16))
    blocks = -(-(queries.agg(size).first()[0] or 0) // BLOCK_BYTES)
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()  # BLOCK_BYTES on average
        part = _search_block(docs, sorted(block, key=lambda r: r["query"]), key, text, top)
        found = part if found is None else found.union(part)
    out = [F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("k").alias(key), "score"]
    if found is None:
        none: list[Column] = [F.lit(None).cast("int").alias("rank"), docs[key].alias("k"), F.lit(0).cast("long").alias("score")]
        return docs.limit(0).select(F.lit(None).cast(items.schema[item_key].dataType).alias("item"), *none).select(*out)
    return found.join(maybe_broadcast(named, named.count(), 128), "query").select(*out)
