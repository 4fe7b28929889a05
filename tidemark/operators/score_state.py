"""Period metrics that are kept up to date: scored rows are folded into a table of score
counts, and metrics come from the counts, so a new batch never reads old rows again.

The state has one row for each batch, period and score with the positives and negatives that
have it. Such rows add up, so a period may arrive in any number of batches. A batch is one
folder, written as a whole when its job commits: adding it again (a replay after a failure)
replaces it and counts nothing twice. Folders are laid out by period, so metrics of some periods
read only those. ``compact`` folds many small batches into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StructType

from tidemark.functions.columns import ratio_or_zero
from tidemark.operators.order import ROWS_PER_BUCKET
from tidemark.operators.ranking import point_metrics, score_points


def add_batch(scored: DataFrame, path: str, batch: int, label: str = "label", prob: str = "prob", period: str = "period") -> None:
    """Fold ``scored`` into the state at ``path`` as ``batch``. Rows without score or label
    count nowhere; a NULL period is a period of its own, an empty string counts as NULL."""
    own = scored.select(F.col(period).alias("period"), F.col(label).alias("label"), F.col(prob).alias("prob"))
    points = score_points(own, group=["period"])
    # One file for each period and task that holds it; periods are few beside scores.
    points.write.mode("overwrite").partitionBy("period").parquet(f"{path}/batch={int(batch)}")


def _stored(spark: SparkSession, path: str, period_type: DataType) -> DataFrame:
    schema = StructType().add("score", DoubleType()).add("pos", DoubleType()).add("neg", DoubleType())
    return spark.read.schema(schema.add("batch", LongType()).add("period", period_type)).parquet(path)


def state_points(
    spark: SparkSession, path: str, period_type: DataType, periods: Sequence | None = None
) -> DataFrame:
    """``period``, ``score``, ``pos``, ``neg`` over all batches; of some ``periods`` only, where
    given. ``period_type`` is the type of the period column that was added."""
    rows = _stored(spark, path, period_type)
    if periods is not None:
        rows = rows.where(F.col("period").isin(list(periods)))
    return rows.groupBy("period", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def compact(spark: SparkSession, path: str, to: str, period_type: DataType, through: int) -> None:
    """Write the state at ``path`` to the new folder ``to`` with the batches up to ``through``
    folded into one of that number; later batches are copied as they are."""
    rows = _stored(spark, path, period_type)
    folded = rows.withColumn("batch", F.greatest(F.col("batch"), F.lit(through).cast("long")))
    points = folded.groupBy("batch", "period", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    points.write.partitionBy("batch", "period").parquet(to)


def state_metrics(points: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """AUC, AP and label rate of each period with both classes, from ``state_points``."""
    per = point_metrics(points, ["period"], rows_per_bucket)
    return per.select(
        "period", "auc", "average_precision", ratio_or_zero("n_pos", F.col("n_pos") + F.col("n_neg")).alias("fraud_rate")
    )


def state_confusion(points: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts of each period at each threshold (a row is flagged above it)."""
    flagged = F.col("score") > F.col("threshold")
    spread = points.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))

    def total(column: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(0.0)).cast("long")

    return spread.groupBy("period", "threshold").agg(
        total("pos", flagged).alias("tp"),
        total("neg", flagged).alias("fp"),
        total("pos", ~flagged).alias("fn"),
        total("neg", ~flagged).alias("tn"),
    )
