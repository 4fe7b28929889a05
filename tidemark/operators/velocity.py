"""Time since the previous row of the same card, with hot cards split into time chunks."""

from __future__ import annotations

import math
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_div
from tidemark.operators.order import bucket_bounds, with_bucket
from tidemark.session import cut_lineage

HOT_ROWS = 5_000_000
#: Counted bytes of the hot cards up to which their table is broadcast.
BROADCAST_BYTES = 8 << 20


def hot_cards(df: DataFrame, card: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cards with more rows than one window task should hold, as a table of any length."""
    counts = df.where(F.col(card).isNotNull()).groupBy(card).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > hot_rows).select(card)


def time_since_previous(
    df: DataFrame,
    card: str,
    time: str,
    key: str,
    name: str = "time_diff",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``time`` minus the previous ``time`` of the card; NULL on a card's first row.

    Ordinary cards are one window group. Rows of a hot card are cut into chunks along
    (time, key), each its own window group, and the first row of a chunk takes the last
    time of the chunk before. A run of equal times too big for a chunk is cut by key.
    """
    order = [F.col(time), F.col(key)]
    # Rows without a card get no difference; set apart by key they gather nowhere.
    apart = F.when(F.col(card).isNull(), F.col(key))
    # Written once, as its count decides the plan; a row for each card, not for each event.
    hot = cut_lineage(hot_cards(df, card, hot_rows).select(F.col(card).alias("_card"), F.lit(True).alias("_hot")))
    n_hot, size = hot.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("_card").cast("string")) + 16)).first()
    if not n_hot:
        w = Window.partitionBy(F.col(card), apart).orderBy(*order)
        return _null_cards(df.withColumn(name, F.col(time) - F.lag(time).over(w)), card, name)

    marks = F.broadcast(hot) if size <= BROADCAST_BYTES else hot
    columns = df.columns
    df = df.join(marks, F.col(card) == F.col("_card"), "left").drop("_card")
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    hot_part = df.where(is_hot).select(F.col(time).alias("_t"), F.col(key).alias("_k"))
    bounds = bucket_bounds(hot_part, "_t", hot_rows)
    runs = sorted({b for i, b in enumerate(bounds) if i and bounds[i - 1] == b})
    in_run = F.col(time).cast("double").isin(*runs) if runs else F.lit(False)
    key_bounds = []
    if runs:
        tied = hot_part.where(F.col("_t").cast("double").isin(*runs))
        key_bounds = bucket_bounds(tied, "_k", hot_rows)
    # A hot time gets an interval of its own, so its key chunks stay in time order.
    time_bounds = sorted({*bounds, *[math.nextafter(r, math.inf) for r in runs]})

    chunked = with_bucket(df, time, time_bounds, "_tc")
    chunked = with_bucket(chunked, key, key_bounds, "_kc")
    chunked = chunked.withColumns(
        {
            "_tc": F.when(is_hot, F.col("_tc")).otherwise(0),
            "_kc": F.when(is_hot & F.coalesce(in_run, F.lit(False)), F.col("_kc").cast("bigint")).otherwise(
                F.when(F.col(card).isNull(), F.xxhash64(key)).otherwise(0)
            ),
        }
    )
    groups = [card, "_tc", "_kc"]
    inner = Window.partitionBy(*groups).orderBy(*order)
    local = chunked.withColumn("_previous", F.lag(time).over(inner))

    across = Window.partitionBy(card).orderBy("_tc", "_kc")
    carried = (
        chunked.where(is_hot)
        .groupBy(*groups)
        .agg(F.max(time).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .select(F.col(card).alias("_c"), F.col("_tc").alias("_ct"), F.col("_kc").alias("_ck"), "_carry")
    )
    cond = (F.col(card) == F.col("_c")) & (F.col("_tc") == F.col("_ct")) & (F.col("_kc") == F.col("_ck"))
    joined = local.join(carried, cond, "left")
    diff = F.col(time) - F.coalesce(F.col("_previous"), F.col("_carry"))
    return _null_cards(joined.withColumn(name, diff).select(*columns, name), card, name)


def _null_cards(df: DataFrame, card: str, name: str) -> DataFrame:
    """Rows without a card have no previous row of that card."""
    return df.withColumn(name, F.when(F.col(card).isNotNull(), F.col(name)))


def with_velocity(df: DataFrame, card: str, time: str, key: str, **kwargs) -> DataFrame:
    """Add ``velocity`` = 1 / (time difference + 1), NULL on a card's first row."""
    timed = time_since_previous(df, card, time, key, "_diff", **kwargs)
    return timed.withColumn("velocity", safe_div(F.lit(1.0), F.col("_diff") + 1)).drop("_diff")
