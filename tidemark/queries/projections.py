"""Row-level features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import (
    day_of_week,
    hour_of_day,
    is_night,
    is_weekend,
    pick,
    plus_one_ratio,
    risk_score,
    row_mean,
    row_sum,
    with_row_std,
    zscore,
)
from tidemark.operators.classification import min_max_normalised
from tidemark.operators.features import (
    FeatureEngineer,
    amount_moments,
    category_codes,
    code_bytes,
    encode,
    engineer,
    impute,
    medians,
    modes,
    scale,
    scaler_stats,
)
from tidemark.operators.joins import left_join_identity
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.profile import with_time_bin
from tidemark.operators.splits import drift_periods
from tidemark.params import Roles, family
from tidemark.queries.base import LINES, SCORED, TX, lines, query, r6, rounded, scored, table, transactions

ROLES = Roles()


@query(
    "prj1_feature_projection",
    f"""WITH {TX} SELECT "TransactionDT", "TransactionAmt", card1, card2, "ProductCD", "DeviceType", dist1, dist2 FROM tx""",
)
def _(spark, d):
    tx = transactions(spark, d)
    return tx.select(*ROLES.features(tx))


@query("prj2_columns_by_type", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(*ROLES.numeric(orders))


@query(
    "prj4_hour_and_day",
    f"""WITH {TX} SELECT "TransactionID", CAST(floor(("TransactionDT" % 86400) / 3600) AS INTEGER) AS hour,
CAST(floor("TransactionDT" / 86400) % 7 AS INTEGER) AS day_of_week FROM tx""",
)
def _(spark, d):
    return transactions(spark, d).select(
        "TransactionID",
        hour_of_day("TransactionDT").alias("hour"),
        day_of_week("TransactionDT").alias("day_of_week"),
    )


@query(
    "prj5_time_period",
    f"""WITH {TX}, s AS (SELECT min("TransactionDT") AS lo, max("TransactionDT") AS hi FROM tx)
SELECT "TransactionID", CAST(greatest(0, least(9, ceil(("TransactionDT" - lo) / ((hi - lo) / 10)) - 1)) AS INTEGER)
AS time_period FROM tx, s""",
)
def _(spark, d):
    tx = transactions(spark, d).select("TransactionID", "TransactionDT")
    return with_time_bin(tx, "TransactionDT").select("TransactionID", "time_period")


@query(
    "prj6_log_amount",
    f"""WITH {TX} SELECT "TransactionID", round(ln(1 + "TransactionAmt"), 6) AS amount_log FROM tx""",
)
def _(spark, d):
    return transactions(spark, d).select("TransactionID", r6(F.log1p("TransactionAmt")).alias("amount_log"))


@query(
    "prj7_amount_zscore",
    f"""WITH {TX}, s AS (SELECT avg("TransactionAmt") AS m, stddev_samp("TransactionAmt") AS sd FROM tx)
SELECT "TransactionID", round(("TransactionAmt" - m) / sd, 6) AS amount_zscore FROM tx, s""",
)
def _(spark, d):
    tx = transactions(spark, d).select("TransactionID", "TransactionAmt")
    mean, std = amount_moments(tx, "TransactionAmt")
    return tx.select("TransactionID", r6(zscore("TransactionAmt", mean, std)).alias("amount_zscore"))


@query(
    "prj8_time_flags",
    f"""WITH {TX}, h AS (SELECT "TransactionID", CAST(floor(("TransactionDT" % 86400) / 3600) AS INTEGER) AS hour,
  CAST(floor("TransactionDT" / 86400) % 7 AS INTEGER) AS dow FROM tx)
SELECT "TransactionID", CAST(dow >= 5 AS INTEGER) AS is_weekend, CAST(hour >= 23 OR hour < 6 AS INTEGER) AS is_night FROM h""",
)
def _(spark, d):
    return transactions(spark, d).select(
        "TransactionID",
        is_weekend(day_of_week("TransactionDT")).alias("is_weekend"),
        is_night(hour_of_day("TransactionDT")).alias("is_night"),
    )


@query(
    "prj9_card_ratio",
    f"""WITH {TX} SELECT "TransactionID", round(card1::DOUBLE / (card2 + 1), 6) AS card1_card2_ratio FROM tx""",
)
def _(spark, d):
    return transactions(spark, d).select("TransactionID", r6(plus_one_ratio("card1", "card2")).alias("card1_card2_ratio"))


@query(
    "prj10_distances",
    f"""WITH {TX} SELECT "TransactionID", round(dist1 + dist2, 6) AS dist_total,
round(dist1 / (dist2 + 1), 9) AS dist_ratio FROM tx""",
)
def _(spark, d):
    return transactions(spark, d).select(
        "TransactionID",
        r6(F.col("dist1") + F.col("dist2")).alias("dist_total"),
        F.round(plus_one_ratio("dist1", "dist2"), 9).alias("dist_ratio"),
    )


def _family_sql(a: str, b: str, prefix: str) -> str:
    return f"""WITH {LINES} SELECT l_orderkey, l_linenumber,
round(coalesce({a}, 0)::DOUBLE + coalesce({b}, 0), 6) AS {prefix}_sum,
round((coalesce({a}, 0)::DOUBLE + coalesce({b}, 0))
  / nullif(CAST({a} IS NOT NULL AS INTEGER) + CAST({b} IS NOT NULL AS INTEGER), 0), 6) AS {prefix}_mean FROM lines"""


@query("prj11_c_family", _family_sql("c1", "c2", "C"))
def _(spark, d):
    df = lines(spark, d)
    cols = family(df, "C")
    return df.select("l_orderkey", "l_linenumber", r6(row_sum(cols)).alias("C_sum"), r6(row_mean(cols)).alias("C_mean"))


@query("prj12_d_family", _family_sql("d1", "d2", "D"))
def _(spark, d):
    df = lines(spark, d)
    cols = family(df, "D")
    return df.select("l_orderkey", "l_linenumber", r6(row_sum(cols)).alias("D_sum"), r6(row_mean(cols)).alias("D_mean"))


@query(
    "prj13_v_family",
    f"""WITH {LINES} SELECT l_orderkey, l_linenumber,
round(list_sum([coalesce(v1, 0), coalesce(v2, 0), coalesce(v3, 0)]), 6) AS "V_sum",
round(list_aggregate(list_filter([v1, v2, v3], lambda x: x IS NOT NULL), 'stddev_samp'), 4) AS "V_std" FROM lines""",
)
def _(spark, d):
    df = lines(spark, d)
    cols = family(df, "V")
    return with_row_std(df, cols, "V_std").select(
        "l_orderkey", "l_linenumber", r6(row_sum(cols)).alias("V_sum"), F.round("V_std", 4).alias("V_std")
    )


@query(
    "prj14_null_fill",
    """WITH j AS (SELECT d.doc_id, CASE WHEN lang <> 'en' THEN lang END AS lang, quality FROM documents d
  LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, coalesce(quality::DOUBLE, (SELECT quantile_cont(quality, 0.5) FROM j)) AS quality,
coalesce(lang, (SELECT lang FROM j WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS lang FROM j""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    df = left_join_identity(docs, table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return impute(df, medians(df, ["quality"]), modes(df, ["lang"]))


@query(
    "prj15_encode_with_unseen",
    """WITH codes AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code
  FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'))
SELECT c_custkey, CAST(coalesce(code, 0) AS INTEGER) AS code FROM customer LEFT JOIN codes ON c_mktsegment = v""",
)
def _(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("code"))
    known = category_codes(customer.where("code <> 'MACHINERY'"), ["code"])
    return encode(customer, ["code"], known, code_bytes(known), {})


@query(
    "prj16_standardise",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1, 6) AS l_quantity,
round((l_extendedprice - m2) / s2, 6) AS l_extendedprice FROM lineitem,
(SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2,
        stddev_pop(l_extendedprice) AS s2 FROM lineitem)""",
)
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    cols = ["l_quantity", "l_extendedprice"]
    row = scaler_stats(df, cols).first()
    stats = {c: (row[f"mean_{i}"], row[f"std_{i}"]) for i, c in enumerate(cols)}
    return rounded(scale(df, stats), cols)


@query("prj17_threshold", f"WITH {SCORED} SELECT key, CAST(prob > 0.5 AS INTEGER) AS pred FROM scored")
def _(spark, d):
    return scored(spark, d).select("key", pick(0.5).alias("pred"))


@query(
    "prj18_class_filter",
    f"""WITH {TX} SELECT "TransactionID", "TransactionAmt" FROM tx WHERE "isFraud" = 1""",
)
def _(spark, d):
    return transactions(spark, d).where(F.col("isFraud") == 1).select("TransactionID", "TransactionAmt")


@query(
    "prj19_periods_with_both_classes",
    f"""WITH {SCORED}, m AS (SELECT period, CASE WHEN period = 1 THEN 0 ELSE label END AS label FROM scored)
SELECT period, count(*) AS n FROM m GROUP BY period HAVING count(DISTINCT label) > 1""",
)
def _(spark, d):
    rows = scored(spark, d, periods=True)
    masked = rows.withColumn("label", F.when(F.col("period") == 1, 0).otherwise(F.col("label")))
    per = masked.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"))
    return per.where(F.col("classes") > 1).drop("classes")


@query(
    "prj20_risk_score",
    f"""WITH {TX}, s AS (SELECT quantile_cont("TransactionAmt", 0.9) AS q90, quantile_cont(dist1, 0.8) AS q80,
  min("TransactionDT") AS t0, max("TransactionDT") AS t1 FROM tx),
h AS (SELECT *, CAST(floor(("TransactionDT" % 86400) / 3600) AS INTEGER) AS hour,
  100 * ("TransactionDT" - t0) / (t1 - t0) AS t FROM tx, s)
SELECT "TransactionID", round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.035::DOUBLE
  + CASE WHEN "TransactionAmt" > q90 THEN 0.02::DOUBLE ELSE 0 END
  + CASE WHEN hour < 6 OR hour > 22 THEN 0.01::DOUBLE ELSE 0 END
  + CASE WHEN "DeviceType" = 'mobile' THEN 0.015::DOUBLE ELSE 0 END
  + CASE WHEN dist1 > q80 THEN 0.01::DOUBLE ELSE 0 END
  + 0.01::DOUBLE * (t / 100))), 6) AS risk FROM h""",
)
def _(spark, d):
    tx = transactions(spark, d)
    q = exact_quantiles(tx, {"amount": F.col("TransactionAmt"), "dist": F.col("dist1")}, [0.8, 0.9])
    span = tx.agg(F.struct(F.min("TransactionDT").alias("t0"), F.max("TransactionDT").alias("t1")).alias("s")).scalar()
    t0, t1 = span.getField("t0"), span.getField("t1")
    risk = risk_score(
        "TransactionAmt",
        hour_of_day("TransactionDT"),
        "DeviceType",
        "dist1",
        F.lit(100) * (F.col("TransactionDT") - t0) / (t1 - t0),
        F.lit(q["amount"][1]),
        F.lit(q["dist"][0]),
    )
    return tx.select("TransactionID", r6(risk).alias("risk"))


@query(
    "prj21_min_max_normalise",
    f"""WITH {SCORED} SELECT key, round((prob - (SELECT min(prob) FROM scored))
/ ((SELECT max(prob) FROM scored) - (SELECT min(prob) FROM scored)), 6) AS prob FROM scored""",
)
def _(spark, d):
    return rounded(min_max_normalised(scored(spark, d).select("key", "prob")), ["prob"])


@query(
    "jn3_fitted_state_join",
    f"""WITH {SCORED}, early AS (SELECT user_id, avg(prob) AS m FROM scored WHERE period = 0 GROUP BY 1)
SELECT s.key, round(prob - coalesce(m, 0), 9) AS excess FROM scored s LEFT JOIN early e ON s.user_id = e.user_id""",
)
def _(spark, d):
    rows = scored(spark, d, periods=True)
    state = rows.where("period = 0").groupBy("user_id").agg(F.avg("prob").alias("m"))
    return rows.join(state, "user_id", "left").select(
        "key", F.round(F.col("prob") - F.coalesce(F.col("m"), F.lit(0.0)), 9).alias("excess")
    )


ENGINEERED = f"""{TX}, s AS (SELECT avg("TransactionAmt") AS m, stddev_samp("TransactionAmt") AS sd FROM tx),
e AS (SELECT tx.*, ln(1 + "TransactionAmt") AS "TransactionAmt_log", ("TransactionAmt" - m) / sd AS "TransactionAmt_zscore",
  CAST(floor(("TransactionDT" % 86400) / 3600) AS INTEGER) AS hour,
  CAST(floor("TransactionDT" / 86400) % 7 AS INTEGER) AS day_of_week,
  card1::DOUBLE / (card2 + 1) AS card1_card2_ratio, dist1 + dist2 AS dist_total, dist1 / (dist2 + 1) AS dist_ratio,
  1 / ("TransactionDT" - lag("TransactionDT") OVER (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID") + 1) AS velocity
  FROM tx, s)"""


@query(
    "mdl12_engineered_rows",
    f"""WITH {ENGINEERED} SELECT "TransactionID", round("TransactionAmt_log", 6) AS "TransactionAmt_log",
round("TransactionAmt_zscore", 6) AS "TransactionAmt_zscore", hour, day_of_week,
round(card1_card2_ratio, 6) AS card1_card2_ratio, round(dist_total, 6) AS dist_total,
round(dist_ratio, 9) AS dist_ratio, round(velocity, 6) AS velocity FROM e""",
)
def _(spark, d):
    out = engineer(transactions(spark, d), ROLES)
    doubles = ["TransactionAmt_log", "TransactionAmt_zscore", "card1_card2_ratio", "dist_total", "dist_ratio", "velocity"]
    coarse = [c for c in doubles if c != "dist_ratio"]
    return rounded(rounded(out, coarse), ["dist_ratio"], 9).select("TransactionID", "hour", "day_of_week", *doubles)


@query(
    "mdl12_fit_transform",
    f"""WITH {ENGINEERED}, k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT "ProductCD" AS v FROM tx)),
x AS (SELECT "TransactionID", "TransactionAmt", hour, velocity, code, dist_ratio FROM e JOIN k ON "ProductCD" = v),
z AS (SELECT avg("TransactionAmt") AS am, stddev_pop("TransactionAmt") AS asd, avg(hour) AS hm, stddev_pop(hour) AS hsd,
  avg(velocity) AS vm, stddev_pop(velocity) AS vsd, avg(code) AS cm, stddev_pop(code) AS csd,
  avg(dist_ratio) AS dm, stddev_pop(dist_ratio) AS dsd FROM x)
SELECT "TransactionID", round(("TransactionAmt" - am) / asd, 6) AS "TransactionAmt", round((hour - hm) / hsd, 6) AS hour,
round((coalesce(velocity, 0) - vm) / vsd, 6) AS velocity, round((code - cm) / csd, 6) AS "ProductCD",
round((dist_ratio - dm) / dsd, 6) AS dist_ratio FROM x, z""",
)
def _(spark, d):
    tx = transactions(spark, d)
    out = FeatureEngineer(ROLES, keep_profile=False).fit(tx).transform(tx)
    cols = ["TransactionAmt", "hour", "velocity", "ProductCD", "dist_ratio"]
    return rounded(out.select("TransactionID", *cols), cols)


@query(
    "agg10_period_features",
    f"""WITH {ENGINEERED}, p AS (SELECT *, least((row_number() OVER (ORDER BY "TransactionDT", "TransactionID") - 1)
  // (count(*) OVER () // 5), 4) AS period FROM e)
SELECT CAST(period AS INTEGER) AS period, count(*) AS n, round(avg("isFraud"), 6) AS fraud_rate,
round(avg("TransactionAmt"), 6) AS mean_amount, round(avg("TransactionAmt_log"), 6) AS mean_log,
round(avg(velocity), 6) AS mean_velocity, min("TransactionDT") AS time_min, max("TransactionDT") AS time_max
FROM p GROUP BY period""",
)
def flagship(spark, d):
    """Read, derive, split into periods and summarise: the whole relational path."""
    tx = transactions(spark, d)
    rows = drift_periods(engineer(tx, ROLES), "TransactionDT", "TransactionID", 5)
    return rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("isFraud")).alias("fraud_rate"),
        r6(F.avg("TransactionAmt")).alias("mean_amount"),
        r6(F.avg("TransactionAmt_log")).alias("mean_log"),
        r6(F.avg("velocity")).alias("mean_velocity"),
        F.min("TransactionDT").alias("time_min"),
        F.max("TransactionDT").alias("time_max"),
    )
