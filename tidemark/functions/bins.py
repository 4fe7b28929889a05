"""Bin numbers as closed-form column expressions.

Dividing by the bin width can land one bin off when a value sits on an edge, so each
function compares the value with the computed edge and corrects by one. The edges are
``low + i * width``, the values a reader of the bin table would print.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import as_column, safe_div


def _clip(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x)).cast("int")


def right_closed_bin(x: Column | str, low: Column, high: Column, k: int) -> Column:
    """0-based equal-width bin ``(edge, edge]``; the first bin also takes the minimum.
    A constant column falls in the middle bin."""
    v = as_column(x).cast("double")
    width = (high - low).cast("double") / F.lit(float(k))
    b = F.ceil(safe_div(v - low, width))
    b = b - (v <= low + (b - 1) * width).cast("int") + (v > low + b * width).cast("int")
    return F.when(v.isNotNull(), F.when(width == 0.0, F.lit((k - 1) // 2)).otherwise(_clip(b - 1, 0, k - 1)))


def left_closed_bin(x: Column | str, low: Column, high: Column, k: int) -> Column:
    """0-based histogram bin ``[edge, edge)``; the last bin also takes the maximum."""
    v = as_column(x).cast("double")
    width = (high - low).cast("double") / F.lit(float(k))
    b = F.floor(safe_div(v - low, width))
    b = b - (v < low + b * width).cast("int") + (v >= low + (b + 1) * width).cast("int")
    return F.when(v.isNotNull(), F.when(width == 0.0, F.lit(k // 2)).otherwise(_clip(b, 0, k - 1)))


def unit_bin(p: Column | str, k: int) -> Column:
    """1-based bin ``(edge, edge]`` of [0, 1]: 0 for p <= 0, k + 1 for p > 1."""
    v = as_column(p).cast("double")
    step = F.lit(1.0 / k)
    b = F.ceil(v * F.lit(float(k)))
    b = b - (v <= (b - 1) * step).cast("int") + (v > b * step).cast("int")
    return F.when(v <= 0.0, 0).when(v > 1.0, k + 1).otherwise(_clip(b, 1, k))
