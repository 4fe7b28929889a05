"""Metrics against small brute-force versions written from the definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.classification import (
    calibration_curve,
    calibration_errors,
    calibration_metrics,
    confusion,
    cost_metrics,
    hosmer_lemeshow,
    reliability,
    reliability_bins,
    threshold_metrics,
)
from tidemark.operators.ranking import (
    TARGET_FPRS,
    TARGET_RECALLS,
    distribution_distance,
    pr_curve,
    precision_at_recall,
    ranking_bundle,
    ranking_metrics,
    roc_curve,
    tpr_at_fpr,
)
from tidemark.operators.stability import pair_periods, period_metrics, stability_summary

SCORED = "key bigint, label int, prob double"


def frame(rows, y, p, partitions=None):
    data = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return rows(data, SCORED, partitions).withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def brute_points(y, p):
    """(threshold, tp, fp) by descending score."""
    return [(t, ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum()) for t in sorted(set(p), reverse=True)]


def brute_ap(y, p):
    total, last = 0.0, 0.0
    for _, tp, fp in brute_points(y, p):
        recall = tp / y.sum()
        total += (recall - last) * tp / (tp + fp)
        last = recall
    return total


def random_scores(n=600, seed=0, ties=True):
    rng = np.random.default_rng(seed)
    y = (rng.uniform(size=n) < 0.2).astype(int)
    p = np.clip(0.3 * y + rng.uniform(size=n) * 0.7, 0, 1)
    return y, np.round(p, 2) if ties else p


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("rows_per_bucket", [40, 10**6])
@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_ranking_is_exact(rows, ties, rows_per_bucket, partitions):
    y, p = random_scores(ties=ties)
    got = ranking_metrics(frame(rows, y, p, partitions), rows_per_bucket=rows_per_bucket).first()
    assert got["auc"] == pytest.approx(brute_auc(y, p))
    assert got["average_precision"] == pytest.approx(brute_ap(y, p))


def test_ranking_edges(rows):
    got = ranking_metrics(frame(rows, [1, 0, 1, 0], [0.5] * 4)).first()
    assert (got["auc"], got["average_precision"]) == (0.5, 0.5)
    got = ranking_metrics(frame(rows, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert (got["auc"], got["average_precision"]) == (1.0, 1.0)
    assert ranking_metrics(frame(rows, [0, 0], [0.1, 0.2])).count() == 0
    assert ranking_metrics(frame(rows, [], [])).count() == 0


def brute_roc(y, p):
    pts = [(t, int(tp), int(fp)) for t, tp, fp in brute_points(y, p)]
    keep = []
    for i, pt in enumerate(pts):
        if 0 < i < len(pts) - 1:
            a, b = pts[i - 1], pts[i + 1]
            if b[1] - pt[1] == pt[1] - a[1] and b[2] - pt[2] == pt[2] - a[2]:
                continue
        keep.append(pt)
    return [(np.inf, 0.0, 0.0)] + [(t, fp / (y == 0).sum(), tp / y.sum()) for t, tp, fp in keep]


@pytest.mark.parametrize("rows_per_bucket", [40, 10**6])
def test_roc_curve_and_operating_points(rows, rows_per_bucket):
    y, p = random_scores(seed=3, ties=False)
    df = frame(rows, y, p, 5)
    expected = brute_roc(y, p)
    curve = roc_curve(df, rows_per_bucket=rows_per_bucket)
    got = [tuple(r) for r in curve.orderBy(F.col("threshold").desc()).collect()]
    np.testing.assert_allclose(np.array(got)[1:], np.array(expected)[1:])
    assert got[0] == expected[0]
    best = tpr_at_fpr(curve).first()
    bundle = ranking_bundle(df, rows_per_bucket=rows_per_bucket).first()
    for t in TARGET_FPRS:
        i = int(np.argmin([abs(f - t) for _, f, _ in expected]))
        name = f"tpr_at_fpr_{t:.3f}".replace(".", "_")
        assert best[name] == bundle[name] == pytest.approx(expected[i][2])


@pytest.mark.parametrize("seed", range(4))
def test_precision_at_recall(rows, seed):
    y, p = random_scores(n=60 if seed % 2 else 9, seed=seed)
    y[0] = 1
    df = frame(rows, y, p, 3)
    points = [(tp / (tp + fp), tp / y.sum()) for _, tp, fp in reversed(brute_points(y, p))] + [(1.0, 0.0)]
    got = precision_at_recall(pr_curve(df)).first()
    bundle = ranking_bundle(df).first()
    for t in TARGET_RECALLS:
        i = int(np.argmin([abs(r - t) for _, r in points]))
        name = f"precision_at_recall_{int(t * 100)}"
        assert got[name] == bundle[name] == pytest.approx(points[i][0])


def test_distribution_distance(rows):
    a, b = rows([(0.1,), (0.2,)], "prob double"), rows([(0.8,), (0.9,)], "prob double")
    assert distribution_distance(a, b).first()["ks"] == 1.0
    assert distribution_distance(a, a).first()["ks"] == 0.0
    x, z = np.random.default_rng(1).normal(size=300), np.random.default_rng(2).normal(0.4, 1, 200)
    grid = np.concatenate([x, z])
    expected = max(abs((x <= v).mean() - (z <= v).mean()) for v in grid)
    got = distribution_distance(*(rows([(float(v),) for v in s], "prob double", 4) for s in (x, z)), rows_per_bucket=50)
    assert got.first()["ks"] == pytest.approx(expected)


def test_threshold_and_cost_metrics(rows):
    df = frame(rows, [1, 1, 0, 0, 0], [0.9, 0.4, 0.8, 0.2, 0.5])
    assert tuple(confusion(df).first()) == (2, 1, 1, 1)
    m = threshold_metrics(df).first()
    assert (m["precision"], m["recall"], m["accuracy"]) == (0.5, 0.5, 0.6)
    assert m["specificity"] == pytest.approx(2 / 3)
    assert m["balanced_accuracy"] == pytest.approx((0.5 + 2 / 3) / 2)
    c = cost_metrics(df).first()
    assert (c["total_cost"], c["cost_per_transaction"], c["fraud_catch_rate"]) == (11.0, 2.2, 0.5)
    none = threshold_metrics(frame(rows, [0, 0], [0.1, 0.2])).first()
    assert (none["precision"], none["recall"], none["f1_score"], none["specificity"]) == (0.0, 0.0, 0.0, 1.0)
    certain = threshold_metrics(frame(rows, [1, 0], [1.0, 0.0])).first()
    assert certain["log_loss"] == pytest.approx(0.0, abs=1e-12)
    wrong = threshold_metrics(frame(rows, [0], [1.0])).first()
    assert wrong["log_loss"] == pytest.approx(-np.log(2.220446049250313e-16))


def brute_ece(y, p, k):
    edges = np.linspace(0, 1, k + 1)
    ece = mce = 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = (p > lo) & (p <= hi)
        if inside.any():
            gap = abs(p[inside].mean() - y[inside].mean())
            ece, mce = ece + gap * inside.mean(), max(mce, gap)
    return ece, mce


@pytest.mark.parametrize("k", [5, 10, 20])
def test_calibration_errors(rows, k):
    y, p = random_scores(seed=5)
    p[:7] = 0.0
    got = calibration_errors(reliability_bins(frame(rows, y, p, 6), bins=k), k).first()
    ece, mce = brute_ece(y, p, k)
    assert (got["calibration_ece"], got["calibration_mce"]) == (pytest.approx(ece), pytest.approx(mce))


def test_zero_probability(rows):
    binned = reliability_bins(frame(rows, [0, 1], [0.0, 1.0]))
    assert calibration_errors(binned).first()["calibration_ece"] == 0.0
    curve = {r["bin"]: (r["fraction_positive"], r["mean_score"]) for r in calibration_curve(binned).collect()}
    assert curve == {1: (0.0, 0.0), 10: (1.0, 1.0)}


def test_reliability_slope_and_single_bin(rows):
    y, p = random_scores(seed=6)
    curve = calibration_curve(reliability_bins(frame(rows, y, p)))
    pts = curve.toPandas()
    got = reliability(curve).first()
    x, f = pts.mean_score.values, pts.fraction_positive.values
    assert got["calibration_reliability_correlation"] == pytest.approx(np.corrcoef(x, f)[0, 1])
    assert got["calibration_reliability_slope"] == pytest.approx(np.cov(x, f)[0, 1] / np.var(x))
    assert got["calibration_slope_ols"] == pytest.approx(np.polyfit(x, f, 1)[0])
    one = reliability(calibration_curve(reliability_bins(frame(rows, [0, 1], [0.55, 0.56])))).first()
    assert tuple(one) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("n", [103, 600])
def test_hosmer_lemeshow(rows, n):
    y, p = random_scores(n=n, seed=7)
    order = np.lexsort((np.arange(n), p))
    size, chi2 = n // 10, 0.0
    for i in range(10):
        at = order[i * size : (i + 1) * size if i < 9 else n]
        o, e = y[at].sum(), p[at].sum()
        no, ne = len(at) - o, len(at) - e + 1e-8
        chi2 += (o - e - 1e-8) ** 2 / (e + 1e-8) + (no - ne) ** 2 / ne
    got = hosmer_lemeshow(frame(rows, y, p, 5), "key").first()[0]
    assert got == pytest.approx(chi2)


def test_calibration_bundle(rows):
    y, p = random_scores(seed=8)
    got = calibration_metrics(frame(rows, y, p), "key").first()
    assert got["calibration_brier_score"] == pytest.approx(np.mean((p - y) ** 2))
    assert got["calibration_overconfidence"] == pytest.approx(p.mean() - y.mean())
    q = (p - p.min()) / (p.max() - p.min())
    got = calibration_metrics(frame(rows, y, p), "key", normalize=True).first()
    assert got["calibration_ece"] == pytest.approx(brute_ece(y, q, 10)[0])


def test_periods_with_one_class_are_skipped(rows):
    data = [(0, 1, 0.9), (0, 0, 0.1), (1, 0, 0.5), (1, 0, 0.6), (2, 1, 0.2), (2, 0, 0.3)]
    per = period_metrics(rows(data, "period int, label int, prob double"))
    got = {r["period"]: r["auc"] for r in per.collect()}
    assert got == {0: 1.0, 2: 0.0}
    s = stability_summary(per).first()
    assert (s["periods"], s["temporal_auc_mean"], s["temporal_auc_std"]) == (2, 0.5, 0.5)
    assert (s["stability_1_minus_std"], s["stability_1_minus_cv"], s["consistency_clamped"]) == (0.5, 0.0, 0.0)
    none = stability_summary(per.where("auc > 2")).first()
    assert (none["temporal_auc_std"], none["temporal_ap_std"], none["consistency_clamped"]) == (1.0, 1.0, 0.0)


def test_unlabelled_periods_drop_out(rows):
    p = rows([(0, 1, 0.5), (1, 2, 0.6)], "period int, key int, prob double")
    labels = rows([(0, 1, 1)], "period int, key int, label int")
    assert [r["period"] for r in pair_periods(p, labels).collect()] == [0]
