"""Extension: live monitoring of scored rows.

The stream carries an event time, ``prob`` and optionally the member probabilities. Per
tumbling window it reports volume, mean score, mean member disagreement and a retraining
flag. State is one row per open window; the watermark closes windows and drops it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.ensemble import disagreement
from tidemark.operators.quantiles import exact_quantiles


def retrain_threshold(validation: DataFrame, members: Sequence[str], quantile: float = 0.95) -> float:
    """Disagreement that a ``quantile`` share of the validation rows stays under."""
    found = exact_quantiles(validation, {"d": disagreement(members)}, [quantile])
    return found["d"][0]


def _window_metrics(members: Sequence[str], row_threshold: float | None) -> list[Column]:
    metrics = [F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_score")]
    if members:
        spread = disagreement(members)
        metrics.append(F.avg(spread).alias("mean_disagreement"))
        if row_threshold is not None:
            metrics.append(F.avg((spread > row_threshold).cast("double")).alias("uncertain_share"))
    return metrics


def monitor(
    scored: DataFrame,
    time: str,
    members: Sequence[str] = (),
    window: str = "1 day",
    delay: str = "1 hour",
    score_threshold: float = 0.6,
    row_threshold: float | None = None,
    uncertain_limit: float = 0.1,
) -> DataFrame:
    """Metrics per tumbling window, for a stream or a table alike. ``retrain`` is raised by
    a mean score over ``score_threshold`` or, with a ``row_threshold`` from
    ``retrain_threshold``, by too large a share of rows the members disagree on."""
    stamped = scored.withColumn(time, F.col(time).cast("timestamp"))
    if scored.isStreaming:
        stamped = stamped.withWatermark(time, delay)
    out = stamped.groupBy(F.window(time, window)).agg(*_window_metrics(members, row_threshold))
    retrain = F.col("mean_score") > score_threshold
    if members and row_threshold is not None:
        retrain = retrain | (F.col("uncertain_share") > uncertain_limit)
    names = [c for c in out.columns if c != "window"]
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names, retrain.alias("retrain")
    )


def period_flags(scored: DataFrame, period: str, members: Sequence[str], row_threshold: float, uncertain_limit: float = 0.1) -> DataFrame:
    """The same trigger per period of a finished table."""
    out = scored.groupBy(period).agg(*_window_metrics(members, row_threshold))
    return out.withColumn("retrain", F.col("uncertain_share") > uncertain_limit)


def read_scored_stream(spark: SparkSession, directory: str, schema: StructType, files: str = "*.parquet") -> DataFrame:
    """Parquet files as they arrive in ``directory``, restricted to names like ``files``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(directory)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and stop; closed windows are appended to ``path`` exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
