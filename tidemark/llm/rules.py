"""Quality rules: base counts, and divergence from the language's reference distributions.

Every language has two references, counted over all its documents: a histogram of character
classes (mean over documents) and of its ``COMMON_WORDS`` most frequent words (mean
share). A document fails when the Jensen-Shannon distance (base 2, 0 to 1) of its own
histogram to a reference passes a limit. Short texts have noisy histograms, so each test has a
minimum length below which it says nothing, and the word limit is what a distance may have
beyond the distance that drawing that many words from the reference would give. A language with fewer than ``MIN_DOCUMENTS``
documents has no reference: its distances are NULL and the base rules alone decide. References
are a written table; it is broadcast when counted small, else joined by language.

Defined results: NULL and empty texts have no words and fail the base rules; a NULL language
is one of its own; repeated rows are judged for every row; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.common import map_keeping, maybe_broadcast, text_of, written

COMMON_WORDS = 100
MIN_DOCUMENTS = 50
#: Limits of the distances, and the least length at which they are tested.
CLASS_LIMIT, CLASS_MIN_CHARS = 0.22, 500
WORD_LIMIT, WORD_MIN_WORDS = 0.15, 100

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
_ALL = "*"
#: Bytes of one reference: its words, their shares and the classes.
_REFERENCE_BYTES = 32 * COMMON_WORDS
#: Texts whose distinct words are counted before they are passed on.
_CHUNK_WORDS = 500_000


# ------------------------------------------------------------------------- one document


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if n >= 3:
        ids = pd.factorize(np.array(words, object))[0].astype(np.int64)
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        _, window, counts = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[window] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeated = int(inside.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


@functools.cache
def _class_table() -> np.ndarray:
    """Character classes of UTF-8 bytes: lower, upper, digit, blank, sentence mark, symbol,
    other printable, control, start of a longer character; continuation bytes have none."""
    table = np.full(256, 7, np.int64)
    for b in range(33, 127):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 5 if c in SYMBOLS else 6
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[192:] = 8
    table[128:192] = 9
    return table


def class_histogram(text: str) -> np.ndarray:
    """Share of each character class."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    out = np.bincount(_class_table(), counts, 10)[:9]
    return out / max(1.0, out.sum())


#: What is taken out of words before they are compared.
_MARKS = (".,;:!?\"'()[]" + SYMBOLS).encode()


def plain_words(text: str) -> list[bytes]:
    """Words in lower case without sentence marks and symbols, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).split()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that sum to 1."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> float:
        own = x > 0
        return float((x[own] * np.log2(x[own] / m[own])).sum())

    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def noise(words: int, bins: int) -> float:
    """Expected distance of a sample of ``words`` from its own distribution over ``bins``."""
    return float(np.sqrt(bins / (8 * np.log(2) * words)))


# ---------------------------------------------------------------------------- references


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    words: dict[bytes, int]  # place of each common word
    shares: np.ndarray  # share of each word among all words, then of all others


def _statistics(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Partial sums per language: of class histograms (``word`` NULL, an array of sums) and of
    word shares. Each document is one vote, split over its words by their frequency."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, dict[bytes, float]] = defaultdict(lambda: defaultdict(float))
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(9))
        docs_of: Counter = Counter()
        held = 0

        def flush() -> pd.DataFrame:
            rows = [(k, None, docs_of[k], classes[k].tolist()) for k in docs_of]
            rows += [(k, w.decode("utf-8", "replace"), c, None) for k, counts in words.items() for w, c in counts.items()]
            return pd.DataFrame(rows, columns=["lang", "word", "n", "classes"])

        for batch in batches:
            for k, t in zip(batch["_lang"], batch["_text"]):
                own = Counter(plain_words(t))
                vote, sums = 1 / max(1, own.total()), words[k]
                for w, c in own.items():
                    sums[w] += vote * c
                classes[k] += class_histogram(t)
                docs_of[k] += 1
                held += len(own)
                if held > _CHUNK_WORDS:
                    yield flush()
                    words.clear(), classes.clear(), docs_of.clear()
                    held = 0
        yield flush()

    narrow = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), text_of(text).alias("_text"))
    return narrow.mapInPandas(run, "lang string, word string, n double, classes array<double>")


def _sums(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """The statistics of whole languages, written once."""
    return written(
        _statistics(docs, lang, text).groupBy("lang", "word").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("classes")[i]) for i in range(9)]).alias("classes")
        ),
        "language-statistics",
    )


def _table(heads: DataFrame, counted: DataFrame) -> DataFrame:
    """A row for each of ``heads``: ``lang``, ``classes``, ``words``, ``counts`` of the common
    words, most frequent first, and ``size``, the sum over all words."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    tops = counted.select("lang", "word", "n", rank.alias("rank")).where(F.col("rank") <= COMMON_WORDS)
    top = F.sort_array(F.collect_list(F.struct("rank", "word", "n")))
    words = tops.groupBy("lang").agg(top.alias("top"))
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("size"))
    return heads.join(words, "lang", "left").join(sizes, "lang", "left").select(
        "lang", "classes", F.col("top.word").alias("words"), F.col("top.n").alias("counts"), "size"
    )


def _reference_table(sums: DataFrame) -> tuple[DataFrame, int]:
    """References of the languages with enough documents, written, and their number."""
    heads = sums.where(F.col("word").isNull() & (F.col("n") >= MIN_DOCUMENTS)).select("lang", "classes")
    few = maybe_broadcast(heads.select("lang"), heads.count(), 64)
    counted = sums.where(F.col("word").isNotNull()).join(few, "lang", "left_semi")
    table = written(_table(heads, counted), "language-references")
    return table, table.count()


def _reference(row) -> Reference:
    row = {"words": None, "counts": None, "size": None} | (row if isinstance(row, dict) else row.asDict())
    words, counts = row["words"], row["counts"]
    counts = np.array([] if counts is None else counts, float)
    shares = np.append(counts, (row["size"] or 0.0) - counts.sum())
    classes = np.array(row["classes"], float)
    places = {w.encode(): i for i, w in enumerate([] if words is None else words)}
    return Reference(classes / max(1e-300, classes.sum()), places, shares / max(1.0, shares.sum()))


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, Reference]:
    """The references by language, and of all documents (``*``, which judges none), on the
    driver: to look at; the operator does not collect them unless counted small."""
    sums = _sums(docs, lang, text)
    heads = sums.where(F.col("word").isNull())
    everything = F.array(*[F.sum(F.col("classes")[i]) for i in range(9)])
    pooled = heads.groupBy(F.lit(_ALL).alias("lang")).agg(everything.alias("classes"))
    words = sums.where(F.col("word").isNotNull()).groupBy(F.lit(_ALL).alias("lang"), "word").agg(F.sum("n").alias("n"))
    rows = _reference_table(sums)[0].collect() + _table(pooled, words).collect()
    return {r["lang"]: _reference(r) for r in rows}


def divergences(text: str, ref: Reference) -> tuple[float | None, float | None]:
    """Distance of the classes, and of the words beyond noise; None below the minimum lengths."""
    by_class = by_word = None
    if len(text) >= CLASS_MIN_CHARS:
        by_class = distance(class_histogram(text), ref.classes)
    words = plain_words(text)
    if len(words) >= WORD_MIN_WORDS:
        other = len(ref.shares) - 1
        counts = np.bincount([ref.words.get(w, other) for w in words], minlength=other + 1)
        by_word = distance(counts / len(words), ref.shares) - noise(len(words), other + 1)
    return by_class, by_word


# ------------------------------------------------------------------------------ operator

_COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "class_distance": "double",
    "word_distance": "double",
    "base_failed": "boolean",
    "kept": "boolean",
}


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: base counts, both distances and the verdict."""
    table, languages = _reference_table(_sums(docs, lang, text))
    small = languages * _REFERENCE_BYTES <= common.BROADCAST_BYTES
    refs = docs.sparkSession.sparkContext.broadcast({r["lang"]: _reference(r) for r in table.collect()} if small else None)

    def work(batch: pd.DataFrame) -> dict[str, list]:
        if small:
            known = refs.value
        else:
            own = batch[batch["_ref"].notna()].drop_duplicates("_lang")
            known = {k: _reference(r) for k, r in zip(own["_lang"], map(json.loads, own["_ref"]))}
        rows = []
        for k, t in zip(batch["_lang"], batch["_text"]):
            n, chars, symbols, lines, repeated = base_counts(t)
            by_class, by_word = divergences(t, known[k]) if k in known else (None, None)
            failed = n < 50 or 100 * repeated > 50 * n
            odd = (by_class or 0.0) > CLASS_LIMIT or (by_word or 0.0) > WORD_LIMIT
            rows.append((n, chars, symbols, lines, repeated, by_class, by_word, failed, not failed and not odd))
        return {c: [r[i] for r in rows] for i, c in enumerate(_COLUMNS)}

    narrow = docs.select(F.col(key), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), text_of(text).alias("_text"))
    if not small:
        # As JSON: a reference is read once for each language of a batch.
        packed = table.select(F.col("lang").alias("_lang"), F.to_json(F.struct("classes", "words", "counts", "size")).alias("_ref"))
        narrow = narrow.join(packed, "_lang", "left")
    return map_keeping(narrow, [key], work, ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())).select(key, *_COLUMNS)
