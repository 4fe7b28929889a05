"""Calibration metrics, isotonic calibration and ensemble weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.classification import (
    calibration_curve,
    calibration_errors,
    calibration_metrics,
    hosmer_lemeshow,
    reliability,
    reliability_bins,
)
from tidemark.operators.ensemble import apply_isotonic, auc_weights, fit_isotonic, long_probabilities, weights_table
from tidemark.operators.learners import weighted_mean
from tidemark.operators.ranking import ranking_metrics
from tidemark.operators.splits import drift_periods
from tidemark.queries.base import CURVE, SCORED, query, r6, rounded, scored, table
from tidemark.sources.readers import epoch_seconds

# Open on the left: p = 0 has bin 0 and stays out of the errors, but counts as a row.
BINS = f"""WITH {SCORED}, b AS (SELECT prob, label, CASE WHEN prob <= 0 THEN 0
  ELSE (SELECT min(k) FROM range(1, 11) r(k) WHERE prob <= CASE WHEN k = 10 THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / 10) END) END AS bin FROM scored),
e AS (SELECT bin, count(*)::DOUBLE AS n, avg(prob) AS conf, avg(label) AS acc FROM b GROUP BY bin)"""


def _binned(spark, d, group=()):
    return reliability_bins(scored(spark, d, periods=bool(group)), group=group)


@query(
    "met5_expected_calibration_error",
    f"{BINS} SELECT round(sum(CASE WHEN bin > 0 THEN abs(conf - acc) * n ELSE 0 END) / sum(n), 6) AS calibration_ece FROM e",
)
def _(spark, d):
    return rounded(calibration_errors(_binned(spark, d)).select("calibration_ece"), ["calibration_ece"])


@query(
    "met6_maximum_calibration_error",
    f"{BINS} SELECT round(max(abs(conf - acc)) FILTER (bin > 0), 6) AS calibration_mce FROM e",
)
def _(spark, d):
    return rounded(calibration_errors(_binned(spark, d)).select("calibration_mce"), ["calibration_mce"])


@query(
    "met5_met6_by_period",
    f"""WITH {SCORED}, b AS (SELECT period, prob, label, CASE WHEN prob <= 0 THEN 0
  ELSE (SELECT min(k) FROM range(1, 11) r(k) WHERE prob <= CASE WHEN k = 10 THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / 10) END) END AS bin FROM scored),
e AS (SELECT period, bin, count(*)::DOUBLE AS n, avg(prob) AS conf, avg(label) AS acc FROM b GROUP BY period, bin)
SELECT period, round(sum(CASE WHEN bin > 0 THEN abs(conf - acc) * n ELSE 0 END) / sum(n), 6) AS calibration_ece,
round(max(abs(conf - acc)) FILTER (bin > 0), 6) AS calibration_mce FROM e GROUP BY period""",
)
def _(spark, d):
    out = calibration_errors(_binned(spark, d, ["period"]), group=["period"])
    return rounded(out, ["calibration_ece", "calibration_mce"])


BRIER = "avg((prob - label) * (prob - label))"


@query("met7_brier_score", f"WITH {SCORED} SELECT round({BRIER}, 6) AS calibration_brier_score FROM scored")
def _(spark, d):
    squares = F.avg(F.pow(F.col("prob") - F.col("label"), 2))
    return scored(spark, d).agg(r6(squares).alias("calibration_brier_score"))


CURVE8 = f"""{BINS}, c AS (SELECT greatest(bin, 1) AS bin, avg(label) AS y, avg(prob) AS x FROM b GROUP BY 1)"""


@query(
    "met8_calibration_curve",
    f"{CURVE8} SELECT CAST(bin AS INTEGER) AS bin, round(y, 6) AS fraction_positive, round(x, 6) AS mean_score FROM c",
)
def _(spark, d):
    return rounded(calibration_curve(_binned(spark, d)), ["fraction_positive", "mean_score"])


@query(
    "met9_reliability",
    f"""{CURVE8} SELECT round(corr(x, y), 6) AS calibration_reliability_correlation,
round(covar_samp(x, y) / var_pop(x), 6) AS calibration_reliability_slope,
round(covar_pop(x, y) / var_pop(x), 6) AS calibration_slope_ols FROM c""",
)
def _(spark, d):
    out = reliability(calibration_curve(_binned(spark, d)))
    return rounded(out, out.columns)


HL = """h AS (SELECT bin, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS o, sum(prob) AS e FROM (
  SELECT *, least((row_number() OVER (ORDER BY prob, key) - 1) // (count(*) OVER () // 10), 9) AS bin FROM scored) GROUP BY bin),
hl AS (SELECT sum(pow(o - e - 1e-8, 2) / (e + 1e-8) + pow(n - o - (n - e + 1e-8), 2) / (n - e + 1e-8)) AS chi2 FROM h)"""


# The chi-square grows without bound when a bin is all ones, so it is compared relative
# to its size: mantissa and exponent.
@query(
    "met10_hosmer_lemeshow",
    f"WITH {SCORED}, {HL} SELECT round(ln(chi2), 4) AS log_chi2 FROM hl",
)
def _(spark, d):
    out = hosmer_lemeshow(scored(spark, d), "key")
    return out.select(F.round(F.ln("calibration_hl_chi2"), 4).alias("log_chi2"))


@query(
    "met11_confidence",
    f"""WITH {SCORED} SELECT round(avg(prob), 6) AS mean_confidence, round(avg(label), 6) AS mean_accuracy,
round(avg(prob) - avg(label), 6) AS overconfidence FROM scored""",
)
def _(spark, d):
    return scored(spark, d).agg(
        r6(F.avg("prob")).alias("mean_confidence"),
        r6(F.avg("label")).alias("mean_accuracy"),
        r6(F.avg("prob") - F.avg("label")).alias("overconfidence"),
    )


BUNDLE = f"""{CURVE8}, {HL}, s AS (SELECT avg(prob) AS mc, avg(label) AS ma, {BRIER} AS brier FROM scored),
er AS (SELECT sum(CASE WHEN bin > 0 THEN abs(conf - acc) * n ELSE 0 END) / sum(n) AS ece, max(abs(conf - acc)) FILTER (bin > 0) AS mce FROM e),
rl AS (SELECT corr(x, y) AS r, covar_samp(x, y) / var_pop(x) AS slope, covar_pop(x, y) / var_pop(x) AS ols FROM c)
SELECT round(ece, 6) AS calibration_ece, round(mce, 6) AS calibration_mce, round(brier, 6) AS calibration_brier_score,
round(mc, 6) AS calibration_mean_confidence, round(ma, 6) AS calibration_mean_accuracy, round(mc - ma, 6) AS calibration_overconfidence,
round(r, 6) AS calibration_reliability_correlation, round(slope, 6) AS calibration_reliability_slope, round(ols, 6) AS calibration_slope_ols,
round(ln(chi2), 4) AS calibration_log_chi2 FROM er, s, rl, hl"""


def _bundle(out):
    scaled = out.withColumn("calibration_log_chi2", F.round(F.ln("calibration_hl_chi2"), 4)).drop("calibration_hl_chi2")
    return rounded(scaled, [c for c in scaled.columns if c != "calibration_log_chi2"])


@query("met12_calibration_bundle", BUNDLE)
def _(spark, d):
    return _bundle(calibration_metrics(scored(spark, d), "key"))


@query(
    "met12_normalised_bundle",
    BUNDLE.replace(SCORED, SCORED.replace("scored AS", "raw AS") + """,
scored AS (SELECT key, label, period, (prob - min(prob) OVER ()) / (max(prob) OVER () - min(prob) OVER ()) AS prob FROM raw)"""),
)
def _(spark, d):
    return _bundle(calibration_metrics(scored(spark, d), "key", normalize=True))


# ------------------------------------------------------- calibration and weighting

# Scores cut to two decimals, so equal scores are common; all rows take part. The fit is the
# max-min formula of isotonic regression over the pooled scores.
@query(
    "mdl8_isotonic_calibration",
    f"""WITH {SCORED}, g AS (SELECT floor(prob * 100) / 100 AS p, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS w FROM scored GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(y) OVER (ORDER BY p) AS sy, sum(w) OVER (ORDER BY p) AS sw FROM g),
ab AS (SELECT a.i AS a, b.i AS b, (b.sy - a.sy + a.y) / (b.sw - a.sw + a.w) AS m FROM c a JOIN c b ON a.i <= b.i),
lo AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM ab),
fit AS (SELECT i, max(m) AS f FROM lo GROUP BY i)
SELECT round(p, 2) AS raw, w::BIGINT AS n, round(f, 6) AS calibrated FROM c JOIN fit USING (i)""",
)
def _(spark, d):
    rows = scored(spark, d).select("label", (F.floor(F.col("prob") * 100.0) / 100.0).alias("raw"))
    model = fit_isotonic(rows, "label", "raw")
    points = rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return apply_isotonic(points, model, "raw", "calibrated").select("raw", "n", r6("calibrated").alias("calibrated"))


MEMBERS = ["m1", "m2", "m3"]
MEMBERS_SQL = """members AS (
  SELECT event_id AS key, CAST(event_type = 'error' AS INTEGER) AS label,
         least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS m1, 1.0::DOUBLE / (1 + value) AS m2,
         floor((epoch_us(ts) / 1e6 % 86400) / 3600) / 24 AS m3,
         CAST(least((row_number() OVER (ORDER BY ts, event_id) - 1) // (count(*) OVER () // 5), 4) AS INTEGER) AS period
  FROM events)"""


def member_rows(spark, d, periods=False):
    """Three deterministic member scores per event."""
    time = epoch_seconds("ts")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("key"),
        time.alias("time"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("m1"),
        (F.lit(1.0) / (1 + F.col("value"))).alias("m2"),
        (F.floor(F.pmod(time, F.lit(86_400)) / 3_600) / F.lit(24.0)).alias("m3"),
    )
    return drift_periods(rows, "time", "key", 5) if periods else rows


MEMBER_AUC = f"""WITH {MEMBERS_SQL}, scored AS (SELECT member, label, p AS prob FROM (UNPIVOT members ON m1, m2, m3 INTO NAME member VALUE p)),
{CURVE.format(g="member")},
a AS (SELECT g AS member, sum(neg * (tp - pos) + 0.5::DOUBLE * pos * neg) / max(n_pos * n_neg) AS auc FROM cum GROUP BY g)"""


def _member_auc(spark, d):
    pairs = F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("prob")) for m in MEMBERS])
    long = member_rows(spark, d).select("label", F.explode(pairs).alias("m")).select("label", "m.*")
    return ranking_metrics(long, group=["member"])


@query(
    "mdl9_auc_weights",
    f"{MEMBER_AUC} SELECT member, round(auc, 6) AS auc, round(auc / sum(auc) OVER (), 6) AS weight FROM a",
)
def _(spark, d):
    return rounded(weights_table(_member_auc(spark, d)), ["auc", "weight"])


@query(
    "mdl10_weighted_mean",
    f"""{MEMBER_AUC}, w AS (SELECT max(auc) FILTER (member = 'm1') AS a1, max(auc) FILTER (member = 'm2') AS a2,
  max(auc) FILTER (member = 'm3') AS a3 FROM a)
SELECT key, round((m1 * a1 + m2 * a2 + m3 * a3) / (a1 + a2 + a3), 6) AS prob FROM members, w""",
)
def _(spark, d):
    auc = {r["member"]: r["auc"] for r in _member_auc(spark, d).collect()}
    weights = auc_weights(auc)
    mean = weighted_mean(MEMBERS, [weights[m] for m in MEMBERS])
    return member_rows(spark, d).select("key", r6(mean).alias("prob"))


@query(
    "mdl11_contributions",
    f"WITH {MEMBERS_SQL} SELECT key, member, round(p, 6) AS prob FROM (UNPIVOT members ON m1, m2, m3 INTO NAME member VALUE p)",
)
def _(spark, d):
    long = long_probabilities(member_rows(spark, d), ["key"], {m: m for m in MEMBERS})
    return long.withColumn("prob", r6("prob"))
