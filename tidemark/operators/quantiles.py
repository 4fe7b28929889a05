"""Exact values at ranks of many columns at once: radix selection in long form.

Every value is read as a 64-bit word in the order of the values. A round looks at the next
few bits of the values that share the known leading bits of a wanted rank, and counts them by
(column, leading bits, next bits): partial counts in every task, one small shuffle, a bounded
number of cells (``CELLS``) on the driver, which walks on to the cell that holds the rank. A
cell whose least and greatest value are equal is settled, and columns without open ranks are
not read again; four to eight rounds settle everything. The plan is the same for one column and
for four hundred, nothing is sampled, sorted or moved, and a value that holds a third of the
rows is one cell like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.operators.order import as_number

#: Cells that a round may count; it decides how many bits a round looks at, from 8 to 16.
CELLS = 1 << 22

_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit words in the order of whole numbers or doubles (without NaN)."""
    if values.dtype.kind == "i":
        return values.astype(np.int64).view(np.uint64) ^ _SIGN
    bits = (values + 0.0).view(np.uint64)  # -0.0 is 0.0
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def value_of(word: int, whole: bool) -> float | int:
    """The value of a word."""
    if whole:
        return word - (1 << 63)
    bits = np.array([word], np.uint64)
    return float(np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(float)[0])


def _cells(values: DataFrame, known: dict[int, list[int]], shift: int, width: int) -> list:
    """Counts, least and greatest word by column, leading bits and next ``width`` bits, of the
    values that have one of the ``known`` leading bits of their column."""
    values = values.select(*[f"v{c}" for c in known])
    cells = 1 << width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for c, prefixes in known.items():
                column = batch.column(f"v{c}").drop_null()
                if not len(column):
                    continue
                words = ordered_bits(column.to_numpy(zero_copy_only=False))
                lead = words >> np.uint64(shift + width) if shift + width < 64 else np.zeros(len(words), np.uint64)
                for p in prefixes:
                    own = words[lead == np.uint64(p)]
                    if not len(own):
                        continue
                    if (c, p) not in total:
                        total[c, p] = [np.zeros(cells, np.int64), np.full(cells, 2**64 - 1, np.uint64), np.zeros(cells, np.uint64)]
                    n, low, high = total[c, p]
                    bits = ((own >> np.uint64(shift)) & np.uint64(cells - 1)).astype(np.int64)
                    n += np.bincount(bits, minlength=cells)
                    np.minimum.at(low, bits, own)
                    np.maximum.at(high, bits, own)
        for (c, p), (n, low, high) in total.items():
            at = np.flatnonzero(n)
            words = ((x[at] ^ _SIGN).view(np.int64) for x in (low, high))
            out = (np.full(len(at), c, np.int32), np.full(len(at), p, np.int64), at.astype(np.int32), n[at], *words)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["c", "p", "bits", "n", "low", "high"])

    parts = values.mapInArrow(run, "c int, p long, bits int, n long, low long, high long")
    summed = parts.groupBy("c", "p", "bits").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.collect()


def values_at_ranks(
    df: DataFrame, columns: dict[str, Column], ranks: Callable[[int], Sequence[int]]
) -> dict[str, tuple[int, list[float | int]]]:
    """For each column the number of values (NULL and NaN left out) and the values at the
    ranks (1-based) that ``ranks`` names for that number. A rank outside 1..n is an error."""
    if not columns:
        return {}
    names = list(columns)
    values = df.select(*[x.alias(f"v{i}") for i, x in enumerate(columns.values())])
    values = values.select(*[as_number(F.col(f.name), f.dataType).alias(f.name) for f in values.schema.fields])
    whole = [isinstance(f.dataType, IntegralType) for f in values.schema.fields]

    sizes = [0] * len(names)
    wanted: dict[int, list[int]] = {}
    settled: dict[tuple[int, int], int] = {}
    open_: dict[tuple[int, int], tuple[int, int]] = {}  # (column, rank): leading bits, values below them
    known = {c: [0] for c in range(len(names))}
    shift = 64
    while known and shift:
        pairs = sum(len(p) for p in known.values())
        width = min(shift, max(8, min(16, (CELLS // pairs).bit_length() - 1)))
        first, shift = shift == 64, shift - width
        found: dict[tuple[int, int], list] = {}
        for r in _cells(values, known, shift, width):
            found.setdefault((r["c"], r["p"]), []).append((r["bits"], r["n"], r["low"], r["high"]))
        for cells in found.values():
            cells.sort()
        if first:
            for c, name in enumerate(names):
                sizes[c] = sum(n for _, n, _, _ in found.get((c, 0), []))
                wanted[c] = [int(r) for r in ranks(sizes[c])]
                for r in wanted[c]:
                    if not 1 <= r <= sizes[c]:
                        raise ValueError(f"{name}: rank {r} outside 1..{sizes[c]}")
                    open_[c, r] = (0, 0)
        next_: dict[tuple[int, int], tuple[int, int]] = {}
        for (c, rank), (lead, below) in open_.items():
            for bits, n, low, high in found[c, lead]:
                if below + n >= rank:
                    if low == high:
                        settled[c, rank] = low + (1 << 63)
                    else:
                        next_[c, rank] = (lead << width | bits, below)
                    break
                below += n
        open_ = next_
        known = {}
        for (c, _), (lead, _) in open_.items():
            if lead not in known.setdefault(c, []):
                known[c].append(lead)
    return {name: (sizes[c], [value_of(settled[c, r], whole[c]) for r in wanted[c]]) for c, name in enumerate(names)}


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of any number of columns; an all-NULL column gives
    NULLs."""

    def ranks(n: int) -> list[int]:
        at = [math.floor((n - 1) * p) + 1 for p in probs]
        return [r for a in at for r in (a, min(a + 1, n))] if n else []

    out: dict[str, list[float | None]] = {}
    for name, (n, values) in values_at_ranks(df, columns, ranks).items():
        if not n:
            out[name] = [None] * len(probs)
            continue
        out[name] = []
        for j, p in enumerate(probs):
            h, low, high = (n - 1) * p, float(values[2 * j]), float(values[2 * j + 1])
            out[name].append(low + (high - low) * (h - math.floor(h)))
    return out
