"""Byte-level BPE with contiguous rank arrays, as a Spark operator.

A text is cut into short words; every distinct word is merged once per worker. For a word
the encoder holds two contiguous arrays: the parts between its boundaries, and the rank of
each adjacent pair. It scans for the smallest rank, deletes that boundary and refreshes the
two neighbouring ranks, until no pair has a rank. Words of similar length are handled
together, one row each, so that a scan is one vectorised minimum. Words longer than
``SHORT_WORD`` bytes would make the repeated scan quadratic; they keep their ranks in a heap
with linked parts, which gives the same merges.

Defined results: NULL and empty texts have no ids; an empty table gives an empty result;
repeated rows give repeated results; further columns are kept out of the way (results are
computed from the two named columns only).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_keeping, text_of

#: Bytes of a word up to which the rank array is scanned.
SHORT_WORD = 64
#: Distinct words a worker remembers; memory is bounded, results do not depend on it.
WORD_CACHE = 500_000
#: Characters of text that are cut into words at a time.
CHUNK_CHARS = 1 << 20

_LETTER, _NUMBER, _SPACE, _OTHER, _UNASSIGNED = range(5)
_NO_RANK = np.iinfo(np.int32).max
_APOSTROPHE = ord("'")


# ------------------------------------------------------------------ cutting into words


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point. Unassigned ones are resolved when a text holds one."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = _LETTER
        elif kind[0] == "N":
            table[cp] = _NUMBER
        elif kind == "Cn":
            table[cp] = _UNASSIGNED
        elif kind in ("Zs", "Zl", "Zp") or 0x09 <= cp <= 0x0D or cp == 0x85:
            table[cp] = _SPACE
    return table


def _resolve(code_points: np.ndarray) -> None:
    """Ask the library's own pre-tokenizer for characters newer than this Python knows."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for cp in np.unique(code_points):
        joined = [k for k, tail in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(cut.pre_tokenize_str(chr(cp) + tail)) == 1]
        _classes()[cp] = joined[0] if joined else _SPACE


def word_starts(text: str) -> np.ndarray:
    """Start offsets of the words of a non-empty text: a run of letters, of numbers or of
    other characters, each with one blank before it; a contraction; white space."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[cps]
    if (kind == _UNASSIGNED).any():
        _resolve(cps[kind == _UNASSIGNED])
        kind = _classes()[cps]
    n = len(cps)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    space = kind == _SPACE
    start = change.copy()
    # A word takes one blank before it; any other white space there is a word of its own.
    first = np.flatnonzero(change[1:] & space[:-1]) + 1
    start[first - 1] = True
    start[first[cps[first - 1] == 32]] = False
    quotes = np.flatnonzero(start & (cps == _APOSTROPHE))
    for i in quotes.tolist():
        for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
            if text.startswith(tail, i + 1):
                start[i + 1] = False
                if i + 1 + len(tail) < n:
                    start[i + 1 + len(tail)] = True
                break
    return np.flatnonzero(start)


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in lists for about ``CHUNK_CHARS`` characters each."""
    if not text:
        return
    starts = word_starts(text)
    step = max(1, int(len(starts) * CHUNK_CHARS / len(text)))
    bounds = [*starts.tolist(), len(text)]
    for k in range(0, len(starts), step):
        part = bounds[k : k + step + 1]
        yield [text[a:b] for a, b in zip(part, part[1:])]


# ---------------------------------------------------------------------- the encoder


class RankArrayBPE:
    """Encoder and decoder for one byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_byte_level(spec):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab = spec["model"]["vocab"]
        symbol = _byte_symbols()
        self.byte_id = np.array([vocab[symbol[b]] for b in range(256)], np.int32)
        back = {s: b for b, s in symbol.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(max(vocab.values()), *self.special.values(), 0)
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(map(back.__getitem__, token))
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        values = np.array([*self.pairs.values()], np.int32)[order]
        self._keys, self._ranks = keys[order], values[:, 0].copy()
        self._merged_of = np.zeros(1 + int(self._ranks.max(initial=0)), np.int32)
        self._merged_of[self._ranks] = values[:, 1]
        left, right = np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)
        self._byte_ranks = self._rank(left, right).reshape(256, 256)
        self._token_sizes = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self._token_ends = np.cumsum(self._token_sizes)
        self._token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._cache: dict[str, bytes] = {}

    # -- one word

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of pairs; no rank where a part is missing (below 0)."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        known = (self._keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self._ranks[at], _NO_RANK)

    def _encode_rows(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of non-empty short words as little-endian 32-bit integers, a row for each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        inside = np.arange(width + 1) < sizes[:, None]
        raw = np.zeros((len(words), width + 1), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        parts = np.where(inside, self.byte_id[raw], -1)
        ranks = np.where(inside[:, 1:], self._byte_ranks[raw[:, :-1], raw[:, 1:]], _NO_RANK)
        live, done = np.arange(len(words)), [b""] * len(words)
        columns = np.arange(width + 1)
        while len(live):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), at]
            over = least == _NO_RANK
            if over.any():
                for r, size in zip(np.flatnonzero(over).tolist(), sizes[over].tolist()):
                    done[live[r]] = parts[r, :size].tobytes()
                keep = ~over
                live, at, sizes, least = live[keep], at[keep], sizes[keep], least[keep]
                parts, ranks = parts[keep], ranks[keep]
            rows = np.arange(len(live))
            # Delete the boundary behind part ``at``: all after it move up by one.
            parts[rows, at] = self._merged_of[least]
            after = columns[1:-1] > at[:, None]
            np.copyto(parts[:, 1:-1], parts[:, 2:].copy(), where=after)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=columns[:-2] > at[:, None])
            sizes = sizes - 1
            parts[rows, sizes] = -1
            # Refresh the ranks on both sides of the new part.
            ranks[rows, at] = self._rank(parts[rows, at], parts[rows, at + 1])
            ranks[rows, sizes - 1] = _NO_RANK
            left = np.flatnonzero(at > 0)
            b = at[left] - 1
            ranks[left, b] = self._rank(parts[left, b], parts[left, b + 1])
        return done

    def _encode_long(self, word: bytes) -> bytes:
        """The same merges for one long word: smallest rank first, leftmost among equals."""
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(self.pairs[p][0], i) for i in range(n - 1) if (p := (part[i], part[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or (found := self.pairs.get((part[i], part[j]))) is None or found[0] != rank:
                continue
            part[i], part[j] = found[1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (part[k], part[after[k]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], k))
        return np.array([p for p in part if p >= 0], "<u4").tobytes()

    # -- texts

    def _learn(self, words: set[str]) -> None:
        short: dict[int, list[str]] = {}
        for w in words:
            b = len(w.encode())
            if b > SHORT_WORD:
                self._cache[w] = self._encode_long(w.encode())
            else:
                short.setdefault((b + 3) // 4, []).append(w)
        for same in short.values():
            for k in range(0, len(same), 4096):
                part = same[k : k + 4096]
                self._cache.update(zip(part, self._encode_rows([w.encode() for w in part])))

    def _pieces(self, text: str) -> list[str | int]:
        """The text between special tokens, and the ids of those tokens."""
        out: list[str | int] = [text]
        for token, i in self.special.items():
            if token in text:
                cut: list[str | int] = []
                for piece in out:
                    parts = piece.split(token) if isinstance(piece, str) else [piece]
                    for k, p in enumerate(parts):
                        cut += [i, p] if k else [p]
                out = cut
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts are read some
        ``CHUNK_CHARS`` characters ahead, so that new words are merged many at a time."""
        ready: list[list[list[str] | int | None]] = [[]]
        unseen: set[str] = set()
        held = 0
        for text in texts:
            for piece in self._pieces(text):
                if isinstance(piece, int):
                    ready[-1].append(piece)
                    continue
                for words in words_of(piece):
                    ready[-1].append(words)
                    unseen.update(words)
                    held += sum(map(len, words))
                    if held >= CHUNK_CHARS:
                        self._settle(ready, unseen)
                        held = 0
                        if len(ready) > 1:
                            yield from map(b"".join, ready[:-1])
                            ready = ready[-1:]
            ready.append([])
        self._settle(ready, unseen)
        yield from map(b"".join, ready[:-1])

    def _settle(self, ready: list[list], unseen: set[str]) -> None:
        """Put ids in place of the words that wait."""
        if len(self._cache) > WORD_CACHE:
            self._cache.clear()
        self._learn(unseen - self._cache.keys())
        unseen.clear()
        for parts in ready:
            for k, p in enumerate(parts):
                if isinstance(p, list):
                    parts[k] = b"".join(map(self._cache.__getitem__, p))
                elif isinstance(p, int):
                    parts[k] = p.to_bytes(4, "little")

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        out = []
        for k in range(0, len(ids), 1 << 20):
            part = np.frombuffer(ids[k : k + (1 << 20)], "<u4")
            sizes = self._token_sizes[part]
            ends = np.cumsum(sizes)
            shift = np.repeat(self._token_ends[part] - ends, sizes)
            out.append(self._token_bytes[shift + np.arange(len(shift))].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def is_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is the plain byte-level kind this encoder reproduces."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    return (
        plain
        and spec.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )


def _byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself where it is printable, else the next
    free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.cache
def encoder(path: str) -> RankArrayBPE:
    """One encoder per worker process and file."""
    return RankArrayBPE(path)


# ------------------------------------------------------------------------- operators


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again, one row for each row of ``docs``.

    Returns ``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with ``with_ids``
    also ``ids`` (array of int) and ``decoded``. A narrow map: no shuffle, memory is one
    Arrow batch and the bounded word cache.
    """
    more = ", ids array<int>, decoded string" if with_ids else ""

    def work(batch: pd.DataFrame) -> dict[str, list]:
        bpe = encoder(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for ids in bpe.encode_all(batch["_text"]):
            back = bpe.decode(ids)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            if with_ids:
                out["ids"].append(np.frombuffer(ids, "<i4"))
                out["decoded"].append(back)
        return out

    narrow = docs.select(F.col(key), text_of(text).alias("_text"))
    return map_keeping(narrow, [key], work, f"n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Decode a column of id arrays; NULL and empty arrays give the empty string."""

    @F.pandas_udf("string")
    def back(column: pd.Series) -> pd.Series:
        bpe = encoder(path)
        return column.map(lambda x: bpe.decode(np.asarray([] if x is None else x, "<u4").tobytes()))

    return rows.withColumn(name, back(F.col(ids)))
