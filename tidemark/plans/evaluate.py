"""Evaluation of a scored frame (key, label, prob, pred[, period]) into a metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.classification import (
    calibration_metrics,
    cost_columns,
    one_row,
    threshold_metrics,
)
from tidemark.operators.drift import detection_metrics
from tidemark.operators.ranking import ranking_bundle
from tidemark.operators.stability import period_metrics, stability_summary
from tidemark.params import EvalParams
from tidemark.sources.sinks import union_metrics, wide_to_metrics
from tidemark.session import write_table


def standard_metrics(scored: DataFrame, key: str, label: str, params: EvalParams = EvalParams()) -> DataFrame:
    """Ranking, threshold, calibration and business metrics as one wide row: one scan for
    the counts, one shuffle of the scores, one binned scan and the equal-count bins."""
    counts = threshold_metrics(scored, label, "pred", "prob")
    short = {"tn": "true_negatives", "fp": "false_positives", "fn": "false_negatives", "tp": "true_positives"}
    costs = (
        counts.withColumns({k: F.col(v) for k, v in short.items()})
        .withColumns(cost_columns(params.cost_fp, params.cost_fn))
        .drop(*short)
    )
    return one_row(
        [costs, ranking_bundle(scored, label, "prob"), calibration_metrics(scored, key, label, "prob", params.bins)]
    )


def temporal_metrics(
    scored: DataFrame, label: str, period: str, drift_scores: DataFrame | None = None, scope: str = "test"
) -> DataFrame:
    """Per-period ranking, its stability and, from one (period, drift_score) row per
    candidate, the quality of the drift detector; in long form."""
    per = write_table(period_metrics(scored, label, "prob", period), "period-metrics")
    parts = [wide_to_metrics(per, scope, period, "period_"), wide_to_metrics(stability_summary(per), scope)]
    if drift_scores is not None:
        parts.append(wide_to_metrics(detection_metrics(drift_scores, period), scope))
    return union_metrics(parts)


def full_evaluation(
    scored: DataFrame,
    key: str,
    label: str,
    params: EvalParams = EvalParams(),
    period: str | None = None,
    drift_scores: DataFrame | None = None,
    scope: str = "test",
) -> DataFrame:
    """All metrics in long form. ``scored`` is scanned by every part, so pass a written or
    checkpointed frame."""
    standard = wide_to_metrics(standard_metrics(scored, key, label, params), scope)
    if period is None:
        return standard
    return standard.unionByName(temporal_metrics(scored, label, period, drift_scores, scope))
