"""Ranking, threshold and business metrics, stability and drift distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.classification import cost_metrics, threshold_metrics
from tidemark.operators.drift import detection_metrics, threshold_sweep
from tidemark.operators.ranking import (
    distribution_distance,
    pr_curve,
    precision_at_recall,
    ranking_bundle,
    ranking_metrics,
    roc_curve,
    tpr_at_fpr,
)
from tidemark.operators.stability import period_metrics, stability_summary
from tidemark.plans.evaluate import full_evaluation
from tidemark.queries.base import CURVE, SCORED, query, r6, rounded, scored
from tidemark.session import write_table

BY_PERIOD = f"WITH {SCORED}, {CURVE.format(g='period')}"
OVERALL = f"WITH {SCORED}, {CURVE.format(g='0')}"
AUC = "sum(neg * (tp - pos) + 0.5::DOUBLE * pos * neg) / max(n_pos * n_neg)"
AP = "sum(pos / n_pos * tp / (tp + fp))"
KS = "max(abs(tp / n_pos - fp / n_neg))"


@query("met1_roc_auc", f"{OVERALL} SELECT round({AUC}, 6) AS auc FROM cum")
def _(spark, d):
    return ranking_metrics(scored(spark, d)).select(r6("auc").alias("auc"))


@query("met2_average_precision", f"{OVERALL} SELECT round({AP}, 6) AS average_precision FROM cum")
def _(spark, d):
    return ranking_metrics(scored(spark, d)).select(r6("average_precision").alias("average_precision"))


@query(
    "met1_ranking_by_user",
    f"""WITH {SCORED}, {CURVE.format(g='user_id')}
SELECT g AS user_id, round({AUC}, 6) AS auc, round({AP}, 6) AS average_precision, round({KS}, 6) AS ks
FROM cum WHERE n_pos > 0 AND n_neg > 0 GROUP BY g""",
)
def _(spark, d):
    per = ranking_metrics(scored(spark, d), group=["user_id"], rows_per_bucket=2_000)
    return rounded(per, ["auc", "average_precision", "ks"]).drop("n_pos", "n_neg")


RATES = f"""m AS (SELECT count(*) FILTER (label = 0 AND pred = 0)::DOUBLE AS tn, count(*) FILTER (label = 0 AND pred = 1)::DOUBLE AS fp,
  count(*) FILTER (label = 1 AND pred = 0)::DOUBLE AS fn, count(*) FILTER (label = 1 AND pred = 1)::DOUBLE AS tp,
  -avg(label * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, prob)))
     + (1 - label) * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, prob)))) AS log_loss FROM scored)"""


@query(
    "met3_threshold_metrics",
    f"""WITH {SCORED}, {RATES}, q AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, tn / (tn + fp) AS s FROM m)
SELECT tn::BIGINT AS true_negatives, fp::BIGINT AS false_positives, fn::BIGINT AS false_negatives, tp::BIGINT AS true_positives,
round(p, 6) AS precision, round(r, 6) AS recall, round(s, 6) AS specificity, round(2 * p * r / (p + r), 6) AS f1_score,
round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((r + s) / 2, 6) AS balanced_accuracy FROM q""",
)
def _(spark, d):
    out = threshold_metrics(scored(spark, d)).drop("log_loss")
    return rounded(out, ["precision", "recall", "specificity", "f1_score", "accuracy", "balanced_accuracy"])


@query("met4_log_loss", f"WITH {SCORED}, {RATES} SELECT round(log_loss, 5) AS log_loss FROM m")
def _(spark, d):
    return rounded(threshold_metrics(scored(spark, d)).select("log_loss"), ["log_loss"], 5)


@query(
    "met13_period_metrics",
    f"""{BY_PERIOD} SELECT g AS period, round({AUC}, 6) AS auc, round({AP}, 6) AS average_precision,
round(max(n_pos / (n_pos + n_neg)), 6) AS fraud_rate FROM cum GROUP BY g""",
)
def _(spark, d):
    return rounded(period_metrics(scored(spark, d, periods=True)), ["auc", "average_precision", "fraud_rate"])


STABILITY = f"""{BY_PERIOD}, p AS (SELECT g, {AUC} AS auc, {AP} AS ap FROM cum GROUP BY g),
s AS (SELECT count(*) AS periods, avg(auc) AS m, stddev_pop(auc) AS sd, min(auc) AS lo, max(auc) AS hi,
      avg(ap) AS am, stddev_pop(ap) AS asd FROM p)"""


@query(
    "met14_robustness_summary",
    f"""{STABILITY} SELECT round(m, 6) AS temporal_auc_mean, round(sd, 6) AS temporal_auc_std, round(lo, 6) AS temporal_auc_min,
round(hi, 6) AS temporal_auc_max, round(am, 6) AS temporal_ap_mean, round(asd, 6) AS temporal_ap_std,
round(1 - sd, 6) AS stability_1_minus_std FROM s""",
)
def _(spark, d):
    out = stability_summary(period_metrics(scored(spark, d, periods=True)))
    out = out.drop("periods", "stability_1_minus_cv", "consistency_clamped")
    return rounded(out, out.columns)


@query(
    "met15_consistency",
    f"""{STABILITY} SELECT round(sd, 6) AS temporal_auc_std, round(asd, 6) AS temporal_ap_std,
round(1 - least(sd / m, 1), 6) AS consistency_clamped FROM s""",
)
def _(spark, d):
    out = stability_summary(period_metrics(scored(spark, d, periods=True)))
    out = out.select("temporal_auc_std", "temporal_ap_std", "consistency_clamped")
    return rounded(out, out.columns)


@query(
    "met16_temporal_performance",
    f"{STABILITY} SELECT periods, round(m, 6) AS temporal_auc_mean, round(1 - sd / m, 6) AS stability_1_minus_cv FROM s",
)
def _(spark, d):
    out = stability_summary(period_metrics(scored(spark, d, periods=True)))
    return rounded(
        out.select("periods", "temporal_auc_mean", "stability_1_minus_cv"), ["temporal_auc_mean", "stability_1_minus_cv"]
    )


PR = "pr AS (SELECT g, score AS t, tp / (tp + fp) AS p, tp / n_pos AS r FROM cum UNION ALL SELECT DISTINCT g, 'inf'::DOUBLE, 1, 0 FROM cum)"
AT_RECALL = ", ".join(
    f"round(arg_min(p, [abs(r - {t}::DOUBLE), t]), 6) AS precision_at_recall_{int(t * 100)}" for t in (0.5, 0.7, 0.8, 0.9, 0.95)
)


@query(
    "met17_pr_curve",
    f"""{BY_PERIOD}, {PR} SELECT g AS period, round(t, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM pr""",
)
def _(spark, d):
    curve = pr_curve(scored(spark, d, periods=True), group=["period"])
    finite = F.when(F.col("threshold") < float("inf"), F.round("threshold", 6)).otherwise(F.col("threshold"))
    return rounded(curve, ["precision", "recall"]).withColumn("threshold", finite)


@query("met17_precision_at_recall", f"{OVERALL}, {PR} SELECT {AT_RECALL} FROM pr")
def _(spark, d):
    out = precision_at_recall(pr_curve(scored(spark, d)))
    return rounded(out, out.columns)


@query("met17_precision_at_recall_by_period", f"{BY_PERIOD}, {PR} SELECT g AS period, {AT_RECALL} FROM pr GROUP BY g")
def _(spark, d):
    out = precision_at_recall(pr_curve(scored(spark, d, periods=True), group=["period"]), group=["period"])
    return rounded(out, [c for c in out.columns if c != "period"])


ROC = """n AS (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS i FROM cum
  WINDOW w AS (PARTITION BY g ORDER BY score DESC)),
roc AS (SELECT g, score AS t, fp / n_neg AS fpr, tp / n_pos AS tpr FROM n
  WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
  UNION ALL SELECT DISTINCT g, 'inf'::DOUBLE, 0, 0 FROM cum)"""
AT_FPR = ", ".join(
    f"round(arg_min(tpr, [abs(fpr - {t}::DOUBLE), -t]), 6) AS tpr_at_fpr_{t:.3f}".replace("fpr_0.", "fpr_0_")
    for t in (0.001, 0.005, 0.01, 0.05, 0.1)
)


@query("met18_roc_curve", f"{OVERALL}, {ROC} SELECT round(t, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def _(spark, d):
    curve = roc_curve(scored(spark, d), rows_per_bucket=1_000)
    finite = F.when(F.col("threshold") < float("inf"), F.round("threshold", 6)).otherwise(F.col("threshold"))
    return rounded(curve, ["fpr", "tpr"]).withColumn("threshold", finite)


@query("met18_tpr_at_fpr", f"{OVERALL}, {ROC} SELECT {AT_FPR} FROM roc")
def _(spark, d):
    out = tpr_at_fpr(roc_curve(scored(spark, d)))
    return rounded(out, out.columns)


@query("met18_tpr_at_fpr_by_period", f"{BY_PERIOD}, {ROC} SELECT g AS period, {AT_FPR} FROM roc GROUP BY g")
def _(spark, d):
    out = tpr_at_fpr(roc_curve(scored(spark, d, periods=True), group=["period"]), group=["period"])
    return rounded(out, [c for c in out.columns if c != "period"])


COST = "(1.0::DOUBLE * fp + 10.0::DOUBLE * fn)"


@query(
    "met19_cost",
    f"WITH {SCORED}, {RATES} SELECT {COST} AS total_cost, round({COST} / (tn + fp + fn + tp), 6) AS cost_per_transaction FROM m",
)
def _(spark, d):
    return rounded(cost_metrics(scored(spark, d)), ["cost_per_transaction"]).select("total_cost", "cost_per_transaction")


@query(
    "met20_catch_and_alarm",
    f"WITH {SCORED}, {RATES} SELECT round(tp / (tp + fn), 6) AS fraud_catch_rate, round(fp / (fp + tn), 6) AS false_alarm_rate FROM m",
)
def _(spark, d):
    out = cost_metrics(scored(spark, d)).select("fraud_catch_rate", "false_alarm_rate")
    return rounded(out, out.columns)


@query(
    "drf7_score_distance",
    f"""WITH {SCORED}, pts AS (SELECT prob AS score, count(*) FILTER (period = 0)::DOUBLE AS a, count(*) FILTER (period > 0)::DOUBLE AS b
  FROM scored GROUP BY 1),
c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM pts WINDOW w AS (ORDER BY score))
SELECT round(max(abs(fa - fb)), 6) AS ks FROM c""",
)
def _(spark, d):
    rows = scored(spark, d, periods=True)
    return rounded(distribution_distance(rows.where("period = 0"), rows.where("period > 0")), ["ks"])


# The mean score of each day stands for its drift score: one candidate per day.
CANDIDATES = f"""WITH {SCORED}, u AS (SELECT floor(time / 86400) AS day, avg(prob) AS s FROM scored GROUP BY 1),
c AS (SELECT s AS score, CAST(row_number() OVER (ORDER BY day) - 1 >= count(*) OVER () // 2 AS INTEGER) AS y FROM u),
t AS (SELECT CASE WHEN i = 99 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE + i * ((0.9::DOUBLE - 0.3::DOUBLE) / 99) END AS thr FROM range(100) r(i)),
x AS (SELECT thr, count(*) FILTER (y = 1 AND score > thr)::DOUBLE AS tp, count(*) FILTER (y = 0 AND score > thr)::DOUBLE AS fp,
  count(*) FILTER (y = 1 AND score <= thr)::DOUBLE AS fn, count(*) FILTER (y = 0 AND score <= thr)::DOUBLE AS tn FROM c, t GROUP BY thr),
f AS (SELECT *, tp / (tp + fn) AS r, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, tn / (tn + fp) AS s FROM x),
h AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f)"""


def daily_scores(spark, d):
    day = F.floor(F.col("time") / 86_400).alias("day")
    return scored(spark, d).groupBy(day).agg(F.avg("prob").alias("drift_score"))


@query(
    "drf8_detection_metrics",
    f"""{CANDIDATES}, a AS (SELECT (SELECT sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END)
    / count(*) FROM c p, c n WHERE p.y = 1 AND n.y = 0)::DOUBLE AS auc)
SELECT round(r, 6) AS drift_detection_recall, round(p, 6) AS drift_detection_precision, round(s, 6) AS drift_detection_specificity,
round(auc, 6) AS drift_detection_auc, round(f1, 6) AS drift_detection_f1, round(thr, 6) AS drift_threshold
FROM h, a ORDER BY f1 DESC, thr LIMIT 1""",
)
def _(spark, d):
    scores = daily_scores(spark, d)
    out = detection_metrics(scores, "day")
    return rounded(out, out.columns)


@query(
    "jn5_threshold_sweep",
    f"""{CANDIDATES} SELECT round(thr, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(f1, 6) AS f1 FROM h""",
)
def _(spark, d):
    scores = daily_scores(spark, d)
    out = threshold_sweep(scores, "day").where(~F.col("fallback"))
    return rounded(out.select("threshold", "tp", "fp", "fn", "tn", "f1"), ["threshold", "f1"])


@query(
    "top4_best_threshold",
    f"{CANDIDATES} SELECT round(thr, 6) AS threshold, round(f1, 6) AS f1 FROM h ORDER BY f1 DESC, thr LIMIT 1",
)
def _(spark, d):
    scores = daily_scores(spark, d)
    out = detection_metrics(scores, "day")
    return out.select(r6("drift_threshold").alias("threshold"), r6("drift_detection_f1").alias("f1"))


@query(
    "met21_ranking_bundle",
    f"""{OVERALL}, {PR}, {ROC}, a AS (SELECT round({AUC}, 6) AS auroc, round({AP}, 6) AS auprc FROM cum),
b AS (SELECT {AT_RECALL} FROM pr), c AS (SELECT {AT_FPR} FROM roc) SELECT * FROM a, b, c""",
)
def _(spark, d):
    out = ranking_bundle(scored(spark, d))
    return rounded(out, out.columns)


@query("met21_full_evaluation")
def _(spark, d):
    """All bundles in long form; every part has its own SQL check above."""
    rows = write_table(scored(spark, d, periods=True), "scored")
    candidates = rows.where("period > 0").groupBy("period").agg(F.avg("prob").alias("drift_score"))
    return full_evaluation(rows, "key", "label", period="period", drift_scores=candidates)
