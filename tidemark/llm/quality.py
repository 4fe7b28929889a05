"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut
its score: P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2 < ... The expected grade is the
sum of these tail probabilities, and selection keeps a document whose tail probability at
``keep_from`` reaches ``keep_share``.

Grades come from the labels: 0 for poor quality, 1 for good quality but toxic, 2 for good and
clean. The model is fitted on at most ``MAX_LABELLED`` labelled documents (those whose keys
hash lowest, so the choice is the same at every run); scoring is a narrow map over all
documents and whole texts.

Defined results: NULL texts count as empty; a document's repeated labels collapse to the
lowest quality and the highest toxicity; labels without a quality are left out; labels for
unknown documents do nothing; with no usable label every document is kept and its
probabilities are NULL; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

#: Labelled documents the model is fitted on at most.
MAX_LABELLED = 6_000
#: Size of the hashed feature space; a power of two.
DIMENSIONS = 1 << 16
GRADES = 3

_PUNCTUATION = b".,;:!?\"'()[]"
#: Shares are cut at these points into one-hot features.
_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: words (lower case, root of their share), bytes that are
    no letters (share), and one-hot ranges of length, repetition and letter case."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().translate(None, _PUNCTUATION).split()
    n = len(words)
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, n)
    distinct, counts = np.unique(hashes, return_counts=True)
    at, value = [distinct & (DIMENSIONS - 1)], [np.sqrt(counts / max(1, n))]

    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    upper, lower = histogram[65:91].sum(), histogram[97:123].sum()
    marks = np.flatnonzero(histogram[:128])
    marks = marks[~(((marks >= 65) & (marks <= 90)) | ((marks >= 97) & (marks <= 122)))]
    at.append(_slots(b"mark", marks))
    value.append(np.minimum(1.0, 20 * histogram[marks] / size))

    lines = [x for x in text.split("\n") if x.strip()]
    repeated = (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0
    shares = [
        1 - len(distinct) / n if n else 1.0,
        repeated,
        1 - len(set(lines)) / len(lines) if lines else 1.0,
        upper / max(1, upper + lower),
        sum(map(len, words)) / (40 * n) if n else 0.0,
    ]
    kinds = np.searchsorted(_STEPS, shares) + 100 * np.arange(len(shares))
    at.append(_slots(b"share", np.append(kinds, 1000 + n.bit_length())))
    value.append(np.ones(len(shares) + 1))
    return np.concatenate(at), np.concatenate(value)


def _slots(kind: bytes, numbers: np.ndarray) -> np.ndarray:
    salt = zlib.crc32(kind)
    return np.array([zlib.crc32(b"%d" % x, salt) & (DIMENSIONS - 1) for x in numbers.tolist()], np.int64)


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and ordered thresholds; empty ``thresholds`` mean no evidence."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        at, value = features(text)
        return _sigmoid(self.weights[at] @ value - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = 200, l2: float = 1e-5, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood by Adam on the whole (bounded) sample. Thresholds are the first one
    and positive gaps, so they stay ordered."""
    if not rows:
        return OrdinalModel(np.zeros(DIMENSIONS), np.empty(0))
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n = len(rows)
    used, column = np.unique(at, return_inverse=True)
    # Start from the thresholds that the grades' shares (with one added to each) give.
    shares = np.bincount(grades, minlength=GRADES) + 1.0
    tails = 1 - np.cumsum(shares)[:-1] / shares.sum()
    start = -np.log(tails / (1 - tails))
    p = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(1e-3, np.diff(start)))])
    k = len(used)
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w = p[:k]
        gaps = np.exp(p[k + 1 :])
        t = np.concatenate([[-np.inf], p[k] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, value * w[column], n)
        up, down = _sigmoid(score - t[grades]), _sigmoid(score - t[grades + 1])
        share = np.maximum(up - down, 1e-12)
        slope_up, slope_down = up * (1 - up) / share, down * (1 - down) / share
        pull = slope_down - slope_up  # of the loss by the score
        g_t = np.bincount(grades, slope_up, GRADES + 1) - np.bincount(grades + 1, slope_down, GRADES + 1)
        g_t = g_t[1:GRADES]
        gradient = np.concatenate(
            [
                np.bincount(column, value * pull[row], k) / n + l2 * w,
                [g_t.sum() / n],
                np.cumsum(g_t[::-1])[::-1][1:] * gaps / n,
            ]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        p = p - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS)
    weights[used] = p[:k]
    return OrdinalModel(weights, p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``grade`` of every labelled document."""
    one = labels.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return one.where(F.col("quality").isNotNull()).select(key, grade.cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents: their features, not their texts, come to
    the driver."""
    sample = graded(labels, key).orderBy(F.xxhash64(key), key).limit(max_labelled)
    known = docs.where(F.col(key).isNotNull()).select(F.col(key), text_of(text).alias("_text"))
    rows = known.join(F.broadcast(sample), key)  # at most max_labelled small rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["_text"]]
            yield pd.DataFrame({"k": batch[key].astype(str), "grade": batch["grade"], "at": [a.astype("<i4").tobytes() for a, _ in found], "value": [v.astype("<f4").tobytes() for _, v in found]})

    got = sorted(rows.mapInPandas(run, "k string, grade int, at binary, value binary").collect(), key=lambda r: (r.k, bytes(r.at)))
    # Repeated documents could pass the bound; the first rows by key stay.
    got = got[:max_labelled]
    parts = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in got]
    return fit(parts, np.array([r.grade for r in got], np.int64))


def score(
    docs: DataFrame,
    model: OrdinalModel,
    key: str = "doc_id",
    text: str = "text",
    keep_from: int = 1,
    keep_share: float = 0.5,
    only_kept: bool = False,
) -> DataFrame:
    """``key``, ``p_good`` (at least grade 1), ``p_clean`` (at least grade 2),
    ``expected_grade`` and ``kept`` for every row; with ``only_kept`` the kept rows of
    ``docs``, unchanged."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers

    @F.pandas_udf("p_good double, p_clean double")
    def tails(texts: pd.Series) -> pd.DataFrame:
        m = weights.value
        if not len(m.thresholds):
            return pd.DataFrame({"p_good": [None] * len(texts), "p_clean": None}, dtype="float64")
        return pd.DataFrame([m.tails(t) for t in texts], columns=["p_good", "p_clean"])

    def kept(of: Column) -> Column:
        return F.coalesce(of.getField("p_good" if keep_from == 1 else "p_clean"), F.lit(1.0)) >= keep_share

    if only_kept:
        return docs.where(kept(tails(text_of(text))))
    good, clean = F.col("_tails.p_good"), F.col("_tails.p_clean")
    return docs.select(F.col(key), tails(text_of(text)).alias("_tails")).select(
        key, good.alias("p_good"), clean.alias("p_clean"), (good + clean).alias("expected_grade"), kept(F.col("_tails")).alias("kept")
    )
