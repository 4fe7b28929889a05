"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are read as words (letters and digits in lower case). The CGK random walk reads a word,
emits it, and moves on by a random bit that depends on the step and the word; two sequences
at a small edit distance fall into step again after an edit, so their outputs differ in few
places: edit distance becomes Hamming distance. Each repetition has its own random bits and
samples some steps of the walk; equal samples make a candidate. Walks start at every word of
documents and items. ``n`` words with ``0.2 n`` edits, evenly spread, leave undisturbed
stretches of four words at best (three or two in the shortest items), so walks are as short
as that, by the length class of the item: other items change nothing. Walks of an item that
sample too few of its words say nothing and are left out. A candidate places the item in the
document; where the words that they share allow it, the exact edit distance to the item-sized
window there decides.

A document leaks an item when some window of it is within ``max_share`` word edits of the
whole item, that is at a similarity of 0.8 or more. Recall of the candidates is measured in
the tests for each length, with ``0.2 n`` edits at random and evenly spread places (at least
0.98). Items with fewer than ``min_words`` words
are no evidence and never leak.

Defined results: NULL and empty texts and items never leak; equal items are all reported;
repeated documents are reported for every row; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_keeping, text_of

#: Items that are indexed at a time; a larger benchmark takes one scan for each block.
BLOCK_ITEMS = 5_000
#: Length classes: least words of an item, steps of a walk, how many of them are sampled, how
#: many words of an item they must see, and the repetitions.
CLASSES = ((12, 8, 7, 3, 12), (8, 6, 6, 3, 16), (0, 4, 4, 2, 12))
#: Words of documents that are walked at once.
CHUNK_WORDS = 200_000

_TO_WORDS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: After these samples (counted from 0) a document's walk goes on only if an item's walk began
#: with the same samples, looked up in a table of so many bits.
NARROWED = (1, 2, 3, 5)
_TABLE_BITS = 20


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    """Word numbers; 0 stands for the padding between texts."""
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)


@dataclass
class Repetition:
    of: np.ndarray  # places of the items of its length class
    steps: list[int]  # sampled steps, ascending
    bits: np.ndarray  # one odd multiplier for each step: the walk's random bits
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # packed: samples that items begin with
    keys: np.ndarray | None = None  # whole samples, sorted
    item: np.ndarray | None = None
    offset: np.ndarray | None = None


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _walk(
    words: np.ndarray, at: np.ndarray, rep: Repetition, tables: dict[int, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Walk from the starts ``at``; returns the surviving starts (as places in ``at``), their
    samples' keys, their last positions, how many words were sampled, and without ``tables`` the keys at ``NARROWED``. With
    them a walk ends once no item begins its samples so: it could only end without a match."""
    place, here, key = np.arange(len(at)), at.copy(), np.zeros(len(at), np.uint64)
    begun: dict[int, np.ndarray] = {}
    seen, before = np.zeros(len(at), np.int64), np.full(len(at), -1)
    done = 0
    for step in range(rep.steps[-1] + 1):
        value = words[here]
        if step == rep.steps[done]:
            key = (key ^ value) * _MIX
            key ^= key >> np.uint64(29)
            if tables is None:
                seen += here != before
                before = here
            if step == rep.steps[-1]:
                break
            if done in NARROWED and tables is None:
                begun[done] = key
            elif done in NARROWED:
                known = tables[done][_slot(key)]
                place, here, key, value = place[known], here[known], key[known], value[known]
            done += 1
        here = here + ((value * rep.bits[step]) >> np.uint64(63)).astype(np.int64)
    return place, key, here, seen, begun


class Matcher:
    """The index over one block of items, and exact matching of texts against it."""

    def __init__(self, items: list[tuple], max_share: float = 0.2, min_words: int = 5):
        self.items, words_of_items = [], []
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) >= min_words:
                masks: dict[bytes, int] = {}
                for i, w in enumerate(words):
                    masks[w] = masks.get(w, 0) | 1 << i
                self.items.append((item_id, len(words), masks, int(max_share * len(words))))
                words_of_items.append(words)
        self.pad = np.zeros(max(span for _, span, *_ in CLASSES) + 2, np.uint64)
        lengths = np.array([n for _, n, *_ in self.items], np.int64)
        self.repetitions: list[Repetition] = []
        above = np.inf
        for least, *shape, repetitions in CLASSES:
            own = np.flatnonzero((lengths >= least) & (lengths < above))
            above = least
            if len(own):
                texts = [words_of_items[i] for i in own]
                self.repetitions += [self._index(r, own, texts, *shape) for r in range(repetitions)]
        self._tables: list[dict[int, np.ndarray]] | None = None

    def _stream(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words with padding behind each text, the starts of walks, and where
        each text begins."""
        parts, starts, begins, total = [], [], [], 0
        for words in texts:
            parts += [_hashes(words), self.pad]
            begins.append(total)
            starts.append(np.arange(total, total + len(words)))
            total += len(words) + len(self.pad)
        return np.concatenate(parts), np.concatenate(starts), np.array(begins)

    def _index(self, number: int, of: np.ndarray, texts: list[list[bytes]], span: int, sampled: int, least: int) -> Repetition:
        rng = np.random.default_rng(1000 + number)
        steps = np.sort(rng.choice(span, sampled, replace=False))
        odd = rng.integers(0, 1 << 63, span, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        rep = Repetition(of, steps.tolist(), odd)
        stream, at, begin = self._stream(texts)
        _, key, last, seen, begun = _walk(stream, at, rep)
        inside = (stream[last] != 0) & (seen >= least)  # walks that left the item say nothing
        for done, keys in begun.items():
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[_slot(keys[inside])] = True
            rep.tables[done] = np.packbits(table)
        item = of[np.searchsorted(begin, at, "right") - 1]
        key, item, offset = key[inside], item[inside], (at - begin[np.searchsorted(begin, at, "right") - 1])[inside]
        order = np.argsort(key, kind="stable")
        rep.keys, rep.item, rep.offset = key[order], item[order], offset[order]
        return rep

    def _unpacked(self) -> list[dict[int, np.ndarray]]:
        """The tables as flags, made where they are used: they travel packed."""
        if self._tables is None:
            self._tables = [{d: np.unpackbits(t).astype(bool) for d, t in r.tables.items()} for r in self.repetitions]
        return self._tables

    def match(self, texts: Iterable[str]) -> Iterator[list[tuple]]:
        """For each text its matches (item id, edits, words of the item), by item."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size >= CHUNK_WORDS:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _chunk(self, docs: list[list[bytes]]) -> Iterator[list[tuple]]:
        if not docs:
            return
        if not self.items:
            yield from ([] for _ in docs)
            return
        stream, at, begin = self._stream(docs)
        found: list[np.ndarray] = []
        for rep, tables in zip(self.repetitions, self._unpacked()):
            place, key, *_ = _walk(stream, at, rep, tables)
            low = np.searchsorted(rep.keys, key, "left")
            many = np.searchsorted(rep.keys, key, "right") - low
            hit = np.flatnonzero(many)
            if len(hit):
                many, low = many[hit], low[hit]
                entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                where = np.repeat(at[place[hit]], many)
                doc = np.searchsorted(begin, where, "right") - 1
                found.append(np.stack([doc, rep.item[entry], where - begin[doc] - rep.offset[entry]], axis=1))
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
        # The exact distance allows for some words before and behind, so starts that lie
        # closer together than that allowance need one check.
        for doc, i, start in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
            _, n, masks, most = self.items[i]
            seen = best[doc].get(i)
            if seen is not None and seen[0] <= start <= seen[1]:
                continue
            window = docs[doc][max(0, start - 2 * most - 1) : start + n + 2 * most + 1]
            # An edit takes away at most one of the item's different words.
            edits = _least_edits(window, n, masks) if len(masks.keys() & set(window)) >= len(masks) - most else n
            least = edits if seen is None else min(edits, seen[2])
            best[doc][i] = (start, start + most, least)
        for rows in best:
            hits = [(self.items[i][0], e, self.items[i][1]) for i, (_, _, e) in rows.items() if e <= self.items[i][3]]
            yield sorted(hits, key=lambda h: (h[0] is None, h[0] if h[0] is not None else 0, h[2]))


def _least_edits(words: list[bytes], n: int, masks: dict[bytes, int]) -> int:
    """Smallest edit distance between the item and any window of ``words``: columns of the
    distance table as bit vectors of +1 and -1 steps."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n
    for w in words:
        equal = masks.get(w, 0)
        across = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | ~(across | plus) & full, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        level = equal | minus
        plus, minus = down | ~(level | up) & full, up & level
        if score < best:
            best = score
    return best


def _blocks(items: DataFrame, item_key: str, text: str) -> Iterator[list[tuple]]:
    """The items, a bounded block at a time."""
    rows = items.select(F.col(item_key).alias("i"), text_of(text).alias("t"))
    blocks = -(-rows.count() // BLOCK_ITEMS)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        yield sorted(((r.i, r.t) for r in part), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    max_share: float = 0.2,
    min_words: int = 5,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row for each document row and item it leaks: ``key``, ``item_id``, ``n_edits`` and
    ``item_words``. A narrow map over the documents for each block of items."""
    sc = docs.sparkSession.sparkContext
    made = f"item_id {items.schema[item_key].dataType.simpleString()}, n_edits long, item_words long"
    narrow = docs.select(F.col(key), text_of(text).alias("_text"))
    out = None
    for block in _blocks(items, item_key, item_text):
        held = sc.broadcast(Matcher(block, max_share, min_words))  # at most BLOCK_ITEMS items

        def work(batch: pd.DataFrame, held=held) -> tuple[list[int], dict[str, list]]:
            rows = [(at, *hit) for at, hits in enumerate(held.value.match(batch["_text"])) for hit in hits]
            at, ids, edits, words = ([r[i] for r in rows] for i in range(4))
            return at, {"item_id": ids, "n_edits": edits, "item_words": words}

        found = map_keeping(narrow, [key], work, made)
        out = found if out is None else out.union(found)
    if out is None:  # no items
        none = ("item_id", items.schema[item_key].dataType), ("n_edits", "long"), ("item_words", "long")
        return docs.limit(0).select(F.col(key), *[F.lit(None).cast(kind).alias(name) for name, kind in none])
    return out


def without_leaks(docs: DataFrame, items: DataFrame, max_share: float = 0.2, min_words: int = 5, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, unchanged."""
    sc = docs.sparkSession.sparkContext
    out = docs
    for block in _blocks(items, item_key, item_text):
        held = sc.broadcast(Matcher(block, max_share, min_words))  # at most BLOCK_ITEMS items

        out = out.where(_is_clean(held, text_of(text)))
    return out


def _is_clean(held, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([not hits for hits in held.value.match(texts)], dtype=bool)

    return run(text)
