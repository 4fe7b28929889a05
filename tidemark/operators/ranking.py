"""Exact ranking metrics over (label, prob), per group, in one pass each.

Rows are first collapsed to one point per group and score, so ties are handled by
construction and a hot score is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_div
from tidemark.operators.order import ROWS_PER_BUCKET, bucket_bounds, running_totals
from tidemark.operators.splits import drift_periods


def score_points(df: DataFrame, label: str = "label", prob: str = "prob", group: Sequence[str] = ()) -> DataFrame:
    """One row per group and score with the positives and negatives that have it."""
    y = F.col(label).cast("double")
    return (
        df.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
        .groupBy(*group, F.col(prob).cast("double").alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1.0 - y).alias("neg"))
    )


def cumulative_points(
    df: DataFrame,
    label: str = "label",
    prob: str = "prob",
    group: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    following: bool = False,
) -> DataFrame:
    """Score points by descending score with ``tp``/``fp`` at or above the score and the
    group's ``n_pos``/``n_neg``."""
    points = score_points(df, label, prob, group)
    bounds = bucket_bounds(df.select(F.col(prob).alias("score")), "score", rows_per_bucket)
    return running_totals(points, group, "score", ["pos", "neg"], bounds, following=following).withColumnsRenamed(
        {"cum_pos": "tp", "cum_neg": "fp", "all_pos": "n_pos", "all_neg": "n_neg"}
    )


def _both_classes() -> Column:
    return (F.col("n_pos") > 0) & (F.col("n_neg") > 0)


def ranking_metrics(
    df: DataFrame,
    label: str = "label",
    prob: str = "prob",
    group: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """ROC AUC, average precision (step sum) and the KS distance between the classes,
    per group. A group with one class has no ranking and is left out."""
    return _ranking_of(cumulative_points(df, label, prob, group, rows_per_bucket), group)


def point_metrics(points: DataFrame, group: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``ranking_metrics`` of rows that were collapsed to ``score_points`` before; points are
    unique by group and score."""
    bounds = bucket_bounds(points, "score", rows_per_bucket)
    totals = running_totals(points, group, "score", ["pos", "neg"], bounds)
    names = {"cum_pos": "tp", "cum_neg": "fp", "all_pos": "n_pos", "all_neg": "n_neg"}
    return _ranking_of(totals.withColumnsRenamed(names), group)


def _ranking_of(cumulative: DataFrame, group: Sequence[str]) -> DataFrame:
    c = cumulative.where(_both_classes())
    pos, neg, tp, fp = (F.col(x) for x in ("pos", "neg", "tp", "fp"))
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    scored = c.groupBy(*group).agg(
        safe_div(F.sum(neg * (tp - pos) + F.lit(0.5) * pos * neg), F.max(n_pos * n_neg)).alias("auc"),
        F.sum(safe_div(pos, n_pos) * safe_div(tp, tp + fp)).alias("average_precision"),
        F.max(F.abs(safe_div(tp, n_pos) - safe_div(fp, n_neg))).alias("ks"),
        F.max(n_pos).alias("n_pos"),
        F.max(n_neg).alias("n_neg"),
    )
    # Without a group Spark returns one row even for no points.
    return scored.where(F.col("auc").isNotNull())


def distribution_distance(
    reference: DataFrame, new: DataFrame, prob: str = "prob", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of two score columns."""
    both = reference.select(F.col(prob).alias("prob"), F.lit(0).alias("label")).unionByName(
        new.select(F.col(prob).alias("prob"), F.lit(1).alias("label"))
    )
    return ranking_metrics(both, rows_per_bucket=rows_per_bucket).select("ks")


def pr_curve(
    df: DataFrame, label: str = "label", prob: str = "prob", group: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Precision and recall at every score, and the end point (1, 0) above all scores."""
    c = cumulative_points(df, label, prob, group, rows_per_bucket).where(F.col("n_pos") > 0)
    point = _point(
        F.col("score"),
        precision=safe_div("tp", F.col("tp") + F.col("fp")),
        recall=safe_div("tp", "n_pos"),
    )
    end = _point(F.lit(float("inf")), precision=F.lit(1.0), recall=F.lit(0.0))
    return _with_end(c, point, end, group)


def _point(threshold: Column, **values: Column) -> Column:
    return F.struct(threshold.alias("threshold"), *[v.alias(k) for k, v in values.items()])


def _highest_score() -> Column:
    return (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))


def _bends() -> Column:
    """The last score, or one whose own step differs from the next."""
    step = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return F.col("next_pos").isNull() | step


def _with_end(c: DataFrame, point: Column, end: Column, group: Sequence[str]) -> DataFrame:
    """Curve points; the row of the highest score also gives the curve's open end."""
    points = F.when(_highest_score(), F.array(end, point)).otherwise(F.array(point))
    return c.select(*group, F.explode(points).alias("p")).select(*group, "p.*")


def roc_curve(
    df: DataFrame, label: str = "label", prob: str = "prob", group: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """ROC points by descending threshold, starting at (0, 0). A point is left out when
    the step to it and the step from it are equal, as the line through it is straight;
    the first and last score always stay."""
    c = cumulative_points(df, label, prob, group, rows_per_bucket, following=True).where(_both_classes())
    point = _point(F.col("score"), fpr=safe_div("fp", "n_neg"), tpr=safe_div("tp", "n_pos"))
    start = _point(F.lit(float("inf")), fpr=F.lit(0.0), tpr=F.lit(0.0))
    return _with_end(c.where(_highest_score() | _bends()), point, start, group)


# The operating points reported.
TARGET_RECALLS = (0.5, 0.7, 0.8, 0.9, 0.95)
TARGET_FPRS = (0.001, 0.005, 0.01, 0.05, 0.1)


def precision_at_recall(curve: DataFrame, targets: Sequence[float] = TARGET_RECALLS, group: Sequence[str] = ()) -> DataFrame:
    """Precision where recall is nearest each target; the lowest threshold wins a tie."""
    recall = F.col("recall")
    return curve.groupBy(*group).agg(
        *[
            F.min_by("precision", F.struct(F.abs(recall - F.lit(t)), F.col("threshold"))).alias(
                f"precision_at_recall_{int(t * 100)}"
            )
            for t in targets
        ]
    )


def tpr_at_fpr(curve: DataFrame, targets: Sequence[float] = TARGET_FPRS, group: Sequence[str] = ()) -> DataFrame:
    """True positive rate where the false positive rate is nearest each target; the
    highest threshold wins a tie."""
    fpr = F.col("fpr")
    return curve.groupBy(*group).agg(
        *[
            F.min_by("tpr", F.struct(F.abs(fpr - F.lit(t)), -F.col("threshold"))).alias(
                f"tpr_at_fpr_{t:.3f}".replace(".", "_")
            )
            for t in targets
        ]
    )


def ranking_bundle(
    df: DataFrame,
    label: str = "label",
    prob: str = "prob",
    group: Sequence[str] = (),
    recalls: Sequence[float] = TARGET_RECALLS,
    fprs: Sequence[float] = TARGET_FPRS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """AUC, AP and all operating points from one pass over the cumulative points, so an
    evaluation shuffles the scores once. Equal to the single metrics above."""
    c = cumulative_points(df, label, prob, group, rows_per_bucket, following=True).where(_both_classes())
    pos, neg, tp, fp = (F.col(x) for x in ("pos", "neg", "tp", "fp"))
    precision, recall, fpr = safe_div(tp, tp + fp), safe_div("tp", "n_pos"), safe_div("fp", "n_neg")
    aggs = [
        safe_div(F.sum(neg * (tp - pos) + F.lit(0.5) * pos * neg), F.max(F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        F.sum(safe_div("pos", "n_pos") * precision).alias("auprc"),
    ]
    for t in recalls:
        gap = F.abs(recall - F.lit(t))
        near = F.min_by(precision, F.struct(gap, F.col("score")))
        # The open end (1, 0) lies at distance t and loses a tie, having the top threshold.
        aggs.append(F.when(F.min(gap) <= t, near).otherwise(1.0).alias(f"precision_at_recall_{int(t * 100)}"))
    on_curve = _highest_score() | _bends()
    for t in fprs:
        gap = F.when(on_curve, F.abs(fpr - F.lit(t)))
        near = F.min_by(recall, F.when(on_curve, F.struct(gap, -F.col("score"))))
        # The start (0, 0) lies at distance t and wins a tie for the same reason.
        name = f"tpr_at_fpr_{t:.3f}".replace(".", "_")
        aggs.append(F.when(F.min(gap) < t, near).otherwise(0.0).alias(name))
    out = c.groupBy(*group).agg(*aggs)
    return out.where(F.col("auroc").isNotNull())


def equal_count_bins(df: DataFrame, prob: str, key: str, bins: int = 10) -> DataFrame:
    """Add ``bin`` 0..k-1 of ``n // k`` rows each by ascending score; the last takes the
    remainder. Same shape as the temporal periods, ordered by score instead of time."""
    return drift_periods(df, prob, key, bins).withColumnRenamed("period", "bin")
