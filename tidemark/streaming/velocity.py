"""Live state: time since the previous row of the same card, and score counts by period.

A card's rows may arrive late and out of order, up to the watermark's delay. They wait in the
card's state until the watermark has passed them and are then put in order, so what comes out
equals the table operator over the same rows. State is one time for each card and the rows of
the open delay; a hot card holds only the latter in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.score_state import add_batch


def live_time_since_previous(
    stream: DataFrame, card: str, time: str, key: str, delay: str = "1 hour", name: str = "time_diff"
) -> DataFrame:
    """``key``, ``time`` and the seconds since the card's previous row, for every row that the
    watermark has passed; NULL on a card's first row and on rows without a card. Equal times are
    ordered by ``key``, which is unique and not NULL. Later rows than ``delay`` are left out."""
    key_type = stream.schema[key].dataType
    out = StructType([StructField(key, key_type), StructField("_us", LongType()), StructField("_gap", LongType())])
    kept = f"last bigint, times array<bigint>, keys array<{key_type.simpleString()}>"

    def step(_group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, keys = state.get if state.exists else (None, [], [])
        waiting = list(zip(times, keys))
        known = True
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip(batch["_us"].tolist(), batch["_key"].tolist())
                known = known and bool(batch["_known"].all())
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        done = [w for w in waiting if w[0] < passed]
        rest = waiting[len(done) :]
        rows = []
        for at, k in done:
            rows.append((k, at, None if last is None else at - last))
            last = at
        # A row without a card is a group of its own and leaves no state behind.
        if rest or known:
            state.update((last, [w[0] for w in rest], [w[1] for w in rest]))
            if rest:
                state.setTimeoutTimestamp(rest[0][0] // 1000)
        else:
            state.remove()
        if rows:
            frame = pd.DataFrame(rows, columns=[key, "_us", "_gap"])
            yield frame.astype({"_gap": "Int64"})

    stamped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    rows = stamped.select(
        F.col(card).alias("_card"),
        F.when(F.col(card).isNull(), F.xxhash64(key)).alias("_apart"),
        F.col(card).isNotNull().alias("_known"),
        F.col(key).alias("_key"),
        F.unix_micros(time).alias("_us"),
        F.col(time).alias("_time"),
    )
    told = rows.groupBy("_card", "_apart").applyInPandasWithState(
        step, out, kept, "append", GroupStateTimeout.EventTimeTimeout
    )
    return told.select(key, F.timestamp_micros("_us").alias(time), (F.col("_gap") / 1e6).alias(name))


def keep_scores(stream: DataFrame, path: str, checkpoint: str, label: str = "label", prob: str = "prob", period: str = "period") -> None:
    """Fold what is there of a scored stream into the score state at ``path`` and stop. A batch
    that is replayed after a failure replaces itself."""
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, path, batch, label, prob, period))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
