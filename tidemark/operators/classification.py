"""Threshold, cost and calibration metrics over (label, prob, pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bins import unit_bin
from tidemark.functions.columns import ratio_or_zero, safe_div
from tidemark.operators.ranking import equal_count_bins

# Fixed value: probabilities are kept this far from 0 and 1 in the log loss.
LOG_EPS = 2.220446049250313e-16


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", group: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*group).agg(
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    )


def log_loss(label: str = "label", prob: str = "prob") -> Column:
    """Aggregate expression."""
    y = F.col(label).cast("double")
    p = F.greatest(F.lit(LOG_EPS), F.least(F.lit(1.0 - LOG_EPS), F.col(prob).cast("double")))
    return -F.avg(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))


def threshold_metrics(df: DataFrame, label: str = "label", pred: str = "pred", prob: str = "prob", group: Sequence[str] = ()) -> DataFrame:
    """Counts, rates and log loss in one aggregation; an undefined rate is 0."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*group).agg(
        F.count_if(~y & ~p).alias("true_negatives"),
        F.count_if(~y & p).alias("false_positives"),
        F.count_if(y & ~p).alias("false_negatives"),
        F.count_if(y & p).alias("true_positives"),
        log_loss(label, prob).alias("log_loss"),
    )
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    specificity = ratio_or_zero(tn, tn + fp)
    return counts.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "specificity": specificity,
            "f1_score": ratio_or_zero(2.0 * precision * recall, precision + recall),
            "accuracy": ratio_or_zero(tp + tn, tp + tn + fp + fn),
            "balanced_accuracy": (recall + specificity) / 2.0,
        }
    )


def cost_columns(cost_fp: float = 1.0, cost_fn: float = 10.0) -> dict[str, Column]:
    """Cost and rates from the confusion counts ``tn``, ``fp``, ``fn``, ``tp``."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = (F.lit(float(cost_fp)) * fp + F.lit(float(cost_fn)) * fn).cast("double")
    return {
        "total_cost": total,
        "cost_per_transaction": safe_div(total, tn + fp + fn + tp),
        "fraud_catch_rate": ratio_or_zero(tp, tp + fn),
        "false_alarm_rate": ratio_or_zero(fp, fp + tn),
    }


def cost_metrics(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    cost_fp: float = 1.0,
    cost_fn: float = 10.0,
    group: Sequence[str] = (),
) -> DataFrame:
    costs = cost_columns(cost_fp, cost_fn)
    return confusion(df, label, pred, group).select(*group, *[c.alias(n) for n, c in costs.items()])


# ----------------------------------------------------------------- calibration


def min_max_normalised(df: DataFrame, prob: str = "prob") -> DataFrame:
    one = df.agg(F.struct(F.min(prob).alias("low"), F.max(prob).alias("high")).alias("r")).scalar()
    low, high = one.getField("low"), one.getField("high")
    return df.withColumn(prob, safe_div(F.col(prob) - low, high - low))


def reliability_bins(df: DataFrame, label: str = "label", prob: str = "prob", bins: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Per group and bin: rows, positives and score total. Bin 0 holds p = 0."""
    return df.groupBy(*group, unit_bin(prob, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("double")).alias("positives"),
        F.sum(F.col(prob).cast("double")).alias("scores"),
        F.sum(F.pow(F.col(prob).cast("double") - F.col(label).cast("double"), 2)).alias("squares"),
    )


def calibration_errors(binned: DataFrame, bins: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error. Rows with p = 0 are in no bin but count in
    the total, as bins are open on the left."""
    n = F.col("rows")
    gap = F.when(F.col("bin").between(1, bins), F.abs(safe_div("scores", n) - safe_div("positives", n)))
    return binned.groupBy(*group).agg(
        F.coalesce(safe_div(F.sum(gap * n), F.sum(n)), F.lit(0.0)).alias("calibration_ece"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("calibration_mce"),
    )


def calibration_curve(binned: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Fraction of positives and mean score per non-empty bin; here p = 0 is in bin 1."""
    merged = binned.groupBy(*group, F.greatest(F.col("bin"), F.lit(1)).alias("bin")).agg(
        F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), F.sum("scores").alias("scores")
    )
    return merged.select(
        *group,
        "bin",
        safe_div("positives", "rows").alias("fraction_positive"),
        safe_div("scores", "rows").alias("mean_score"),
    )


def reliability(curve: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Correlation and slope over the curve points; below two points both are 0. The
    slope divides the sample covariance by the population variance; ``slope_ols`` is the
    least-squares one."""
    x, y = F.col("mean_score"), F.col("fraction_positive")
    agg = curve.groupBy(*group).agg(
        F.count(F.lit(1)).alias("k"),
        F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"),
        F.covar_pop(x, y).alias("cp"),
        F.covar_samp(x, y).alias("cs"),
    )
    enough = F.col("k") >= 2
    return agg.select(
        *group,
        F.when(enough, ratio_or_zero("cp", F.sqrt(F.col("vx") * F.col("vy")))).otherwise(0.0).alias(
            "calibration_reliability_correlation"
        ),
        F.when(enough, ratio_or_zero("cs", "vx")).otherwise(0.0).alias("calibration_reliability_slope"),
        F.when(enough, ratio_or_zero("cp", "vx")).otherwise(0.0).alias("calibration_slope_ols"),
    )


def hosmer_lemeshow(df: DataFrame, key: str, label: str = "label", prob: str = "prob", bins: int = 10) -> DataFrame:
    """Chi-square over equal-count score bins."""
    tiny = 1e-8
    per_bin = equal_count_bins(df, prob, key, bins).groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("double")).alias("observed"),
        F.sum(F.col(prob).cast("double")).alias("expected"),
    )
    rows, observed, expected = F.col("rows"), F.col("observed"), F.col("expected")
    up, down = expected + F.lit(tiny), rows - expected + F.lit(tiny)
    term = safe_div(F.pow(observed - up, 2), up) + safe_div(F.pow(rows - observed - down, 2), down)
    return per_bin.agg(F.sum(term).alias("calibration_hl_chi2"))


def calibration_metrics(
    df: DataFrame,
    key: str,
    label: str = "label",
    prob: str = "prob",
    bins: int = 10,
    normalize: bool = False,
) -> DataFrame:
    """The calibration bundle as one row. All but the chi-square come from one binned
    aggregation of at most ``bins + 2`` rows."""
    scored = min_max_normalised(df, prob) if normalize else df
    binned = reliability_bins(scored, label, prob, bins)
    n = F.sum("rows")
    scalars = binned.agg(
        safe_div(F.sum("squares"), n).alias("calibration_brier_score"),
        safe_div(F.sum("scores"), n).alias("calibration_mean_confidence"),
        safe_div(F.sum("positives"), n).alias("calibration_mean_accuracy"),
    ).withColumn(
        "calibration_overconfidence", F.col("calibration_mean_confidence") - F.col("calibration_mean_accuracy")
    )
    parts = [
        calibration_errors(binned, bins),
        scalars,
        reliability(calibration_curve(binned)),
        hosmer_lemeshow(scored, key, label, prob, bins),
    ]
    return one_row(parts)


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Put one-row frames side by side: each is a global aggregate, joined on a constant
    key, so the join moves one row per part."""
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")
