"""Temporal splits and periods as a label column on one DataFrame.

A split needs only the rows at the cut ranks, so all but the random hold-out and the
folds are a projection over ``cut_points``: no sort, no shuffle, no union of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import stable_hash
from tidemark.operators.order import CANDIDATES, cut_points, row_index, row_rest


def temporal_split(
    df: DataFrame,
    time: str,
    key: str,
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Add ``split``: the earliest rows are train, then val, the rest test."""
    train, val, test = ratios
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError(f"ratios must sum to 1, got {ratios}")
    first, second = cut_points(
        df, time, key, lambda n: [int(n * train), int(n * (train + val))], candidates=candidates
    )["all"]
    row = F.col(time), F.col(key), row_rest(df)
    label = F.when(first.holds(*row), "train").when(second.holds(*row), "val").otherwise("test")
    return df.withColumn("split", label)


def drift_periods(
    df: DataFrame, time: str, key: str, periods: int = 5, candidates: int = CANDIDATES
) -> DataFrame:
    """Add ``period`` 0..k-1 of ``n // k`` rows each; the last takes the remainder."""
    cuts = cut_points(
        df, time, key, lambda n: [i * (n // periods) for i in range(1, periods)], candidates=candidates
    )["all"]
    period = F.lit(0)
    for cut in cuts:
        period = period + (~cut.holds(F.col(time), F.col(key), row_rest(df))).cast("int")
    return df.withColumn("period", period)


def stratified_temporal_split(
    df: DataFrame,
    time: str,
    key: str,
    label: str,
    train_ratio: float = 0.7,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Add ``split``: per class the earliest share is train, the rest test. Rows of any
    other label are left out, as there is no class to keep the balance of."""
    classes: dict[str, Column] = {"normal": F.col(label) == 0, "positive": F.col(label) == 1}
    cuts = cut_points(df, time, key, lambda n: [int(n * train_ratio)], classes, candidates)
    row = F.col(time), F.col(key), row_rest(df)
    early = F.lit(False)
    for name, cond in classes.items():
        early = early | (cond & cuts[name][0].holds(*row))
    return df.where(F.col(label).isin(0, 1)).withColumn(
        "split", F.when(early, "train").otherwise("test")
    )


def half_split(df: DataFrame, time: str, key: str, candidates: int = CANDIDATES) -> DataFrame:
    """Add ``domain``: 0 for the earlier half of the rows, 1 for the later."""
    cut = cut_points(df, time, key, lambda n: [n // 2], candidates=candidates)["all"][0]
    early = cut.holds(F.col(time), F.col(key), row_rest(df))
    return df.withColumn("domain", F.when(early, 0).otherwise(1))


def random_holdout(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``holdout`` from a hash of the key: stable under any partitioning."""
    held = F.pmod(stable_hash(key, seed), F.lit(10_000)) < F.lit(int(round(fraction * 10_000)))
    return df.withColumn("holdout", held.cast("int"))


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int = 3, seed: int = 42, candidates: int = CANDIDATES
) -> DataFrame:
    """Add ``fold``: rows of a class are dealt to the folds in hash order in equal blocks,
    so every fold holds the same share of each class."""
    hashed = df.withColumn("_hash", stable_hash(key, seed))
    classes: dict[str, Column] = {"normal": F.col(label) == 0, "positive": F.col(label) == 1}
    cuts = cut_points(
        hashed, "_hash", key, lambda n: [i * n // folds for i in range(1, folds)], classes, candidates
    )
    fold = F.lit(0)
    for name, cond in classes.items():
        for cut in cuts[name]:
            fold = fold + (cond & ~cut.holds(F.col("_hash"), F.col(key), row_rest(hashed))).cast("int")
    return hashed.withColumn("fold", fold).drop("_hash")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42, candidates: int = CANDIDATES) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by hash of the key. The threshold hash is
    selected first, so a large sample is a filter and not a top-n in one task."""
    hashed = df.withColumn("_hash", stable_hash(key, seed))
    cut = cut_points(hashed, "_hash", key, lambda size: [min(n, size)], candidates=candidates)["all"][0]
    return hashed.where(cut.holds(F.col("_hash"), F.col(key), row_rest(hashed))).drop("_hash")


def class_positions(df: DataFrame, time: str, key: str, label: str) -> DataFrame:
    """Time-ordered position within each class."""
    return row_index(df, [time, key], [label], "class_position")

