"""How even the ranking quality is across periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio_or_zero
from tidemark.operators.order import ROWS_PER_BUCKET
from tidemark.operators.ranking import ranking_metrics


def period_metrics(
    df: DataFrame, label: str = "label", prob: str = "prob", period: str = "period", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """AUC, AP and label rate per period with both classes; one job for all periods."""
    per = ranking_metrics(df, label, prob, [period], rows_per_bucket)
    return per.select(
        period,
        "auc",
        "average_precision",
        ratio_or_zero("n_pos", F.col("n_pos") + F.col("n_neg")).alias("fraud_rate"),
    )


def stability_summary(periods: DataFrame) -> DataFrame:
    """Spread over the per-period metrics (one row per period) and three stability scores.

    They differ on purpose: 1 - std, 1 - std / mean, and the latter held at 0 from below.
    Without a valid period the consistency is 0 and the spreads are 1.
    """
    mean, std = F.col("temporal_auc_mean"), F.col("temporal_auc_std")
    agg = periods.agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg("auc").alias("temporal_auc_mean"),
        F.coalesce(F.stddev_pop("auc"), F.lit(1.0)).alias("temporal_auc_std"),
        F.min("auc").alias("temporal_auc_min"),
        F.max("auc").alias("temporal_auc_max"),
        F.avg("average_precision").alias("temporal_ap_mean"),
        F.coalesce(F.stddev_pop("average_precision"), F.lit(1.0)).alias("temporal_ap_std"),
    )
    spread = F.try_divide(std, mean)
    valid = F.col("periods") > 0
    return agg.withColumns(
        {
            "stability_1_minus_std": F.when(valid, 1.0 - std),
            "stability_1_minus_cv": F.when(valid, F.coalesce(1.0 - spread, F.lit(0.0))),
            "consistency_clamped": F.when(valid, 1.0 - F.least(F.coalesce(spread, F.lit(1.0)), F.lit(1.0))).otherwise(0.0),
        }
    )


def pair_periods(predictions: DataFrame, labels: DataFrame, period: str = "period", key: str = "key") -> DataFrame:
    """Scores and labels kept per period in two tables, matched by period and row key;
    a period without labels drops out."""
    return predictions.join(labels, [period, key])

