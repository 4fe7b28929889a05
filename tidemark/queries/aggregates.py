"""Profiles, frequencies and fitted statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.classification import confusion
from tidemark.operators.features import category_codes, medians, modes_table, scaler_stats, unknown_categories
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.profile import (
    category_frequencies,
    correlations,
    drift_profile,
    histogram,
    member_scores,
    numeric_profile,
    period_summary,
    rate_by_hour,
    rate_by_time_bin,
    top_categories,
)
from tidemark.operators.splits import drift_periods, half_split
from tidemark.params import Roles
from tidemark.queries.base import SCORED, TX, query, r6, rounded, scored, table, transactions

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query(
    "agg1_numeric_profile",
    _union(
        """SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem""",
        NUMBERS,
    ),
)
def _(spark, d):
    profile = numeric_profile(table(spark, d, "lineitem").select(*NUMBERS), NUMBERS)
    return rounded(profile, ["mean", "std", "q25", "q75"])


@query(
    "agg2_category_frequencies",
    _union(
        """SELECT '{c}' AS feature, {c} AS value, round(count(*) / (SELECT count({c}) FROM orders)::DOUBLE, 6) AS frequency
FROM orders WHERE {c} IS NOT NULL GROUP BY {c}""",
        ["o_orderstatus", "o_orderpriority"],
    ),
)
def _(spark, d):
    return rounded(category_frequencies(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]), ["frequency"])


@query(
    "agg3_drift_profile",
    _union(
        """SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
round(skewness({c}), 5) AS skew FROM lineitem""",
        NUMBERS,
    ),
)
def _(spark, d):
    profile = drift_profile(table(spark, d, "lineitem").select(*NUMBERS), NUMBERS)
    return rounded(rounded(profile, ["mean", "std"]), ["skew"], 5)


@query(
    "agg4_top_categories",
    """WITH f AS (SELECT c_name AS value, count(*) AS n FROM customer GROUP BY 1
UNION ALL SELECT NULL, NULL WHERE false),
t AS (SELECT 'c_name' AS feature, value, n::DOUBLE / sum(n) OVER () AS frequency FROM f
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*)::DOUBLE / (SELECT count(*) FROM customer) FROM customer GROUP BY 2),
k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY frequency DESC, value) AS rank FROM t)
SELECT feature, value, round(frequency, 6) AS frequency, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
)
def _(spark, d):
    return rounded(top_categories(table(spark, d, "customer"), ["c_name", "c_mktsegment"], 5), ["frequency"])


@query(
    "agg5_exact_medians",
    _union("SELECT '{c}' AS feature, quantile_cont({c}, 0.5)::DOUBLE AS median FROM lineitem", [*NUMBERS, "l_suppkey"]),
)
def _(spark, d):
    cols = [*NUMBERS, "l_suppkey"]
    found = medians(table(spark, d, "lineitem"), cols)
    return spark.createDataFrame([(c, float(found[c])) for c in cols], "feature string, median double")


@query(
    "agg6_modes",
    """SELECT 'o_orderstatus' AS feature, (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode
UNION ALL SELECT 'o_orderpriority', (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
)
def _(spark, d):
    return modes_table(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "agg7_category_codes",
    """SELECT 'c_mktsegment' AS feature, v AS value, row_number() OVER (ORDER BY v) - 1 AS code
FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)
UNION ALL SELECT 'c_name', v, row_number() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT c_name AS v FROM customer)""",
)
def _(spark, d):
    return category_codes(table(spark, d, "customer"), ["c_mktsegment", "c_name"])


@query(
    "agg8_scaler_stats",
    """SELECT round(avg(l_quantity), 6) AS mean_0, round(avg(l_tax), 6) AS mean_1,
round(stddev_pop(l_quantity), 6) AS std_0, round(stddev_pop(l_tax), 6) AS std_1 FROM lineitem""",
)
def _(spark, d):
    stats = scaler_stats(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    return rounded(stats, stats.columns)


@query(
    "agg9_label_rate",
    f"WITH {SCORED} SELECT round(avg(label), 6) AS fraud_rate, round(avg(pred), 6) AS predicted_rate FROM scored",
)
def _(spark, d):
    return scored(spark, d).agg(r6(F.avg("label")).alias("fraud_rate"), r6(F.avg("pred")).alias("predicted_rate"))


@query(
    "agg10_period_summary",
    f"""WITH {TX}, p AS (SELECT *, least((row_number() OVER (ORDER BY "TransactionDT", "TransactionID") - 1)
  // (count(*) OVER () // 7), 6) AS period FROM tx)
SELECT CAST(period AS INTEGER) AS period, count(*) AS n, round(avg("isFraud"), 6) AS fraud_rate,
round(avg("TransactionAmt"), 6) AS mean_amount, min("TransactionDT") AS time_min, max("TransactionDT") AS time_max
FROM p GROUP BY period""",
)
def _(spark, d):
    rows = drift_periods(transactions(spark, d), "TransactionDT", "TransactionID", 7)
    return rounded(period_summary(rows, Roles()), ["fraud_rate", "mean_amount"])


@query(
    "agg11_rate_by_time_bin",
    f"""WITH {TX}, s AS (SELECT min("TransactionDT") AS lo, max("TransactionDT") AS hi FROM tx),
b AS (SELECT CAST(greatest(0, least(19, ceil(("TransactionDT" - lo) / ((hi - lo) / 20)) - 1)) AS INTEGER) AS bin, "isFraud" FROM tx, s)
SELECT CAST(r.range AS INTEGER) AS bin, count(b.bin) AS n, round(avg("isFraud"), 6) AS fraud_rate
FROM range(20) r LEFT JOIN b ON b.bin = r.range GROUP BY 1""",
)
def _(spark, d):
    return rounded(rate_by_time_bin(transactions(spark, d), "TransactionDT", "isFraud", 20), ["fraud_rate"])


@query(
    "agg12_rate_by_hour",
    f"""WITH {TX} SELECT CAST(floor(("TransactionDT" % 86400) / 3600) AS INTEGER) AS hour,
round(avg("isFraud"), 6) AS fraud_rate FROM tx GROUP BY 1""",
)
def _(spark, d):
    return rounded(rate_by_hour(transactions(spark, d), "TransactionDT", "isFraud"), ["fraud_rate"])


@query(
    "agg13_histogram_by_class",
    f"""WITH {SCORED}, s AS (SELECT min(prob) AS lo, max(prob) AS hi FROM scored),
b AS (SELECT label, CAST(least(19, floor((prob - lo) / ((hi - lo) / 20))) AS INTEGER) AS i, prob, lo, (hi - lo) / 20 AS w FROM scored, s),
f AS (SELECT label, w, lo, CASE WHEN prob < lo + i * w THEN i - 1 WHEN prob >= lo + (i + 1) * w AND i < 19 THEN i + 1 ELSE i END AS bin FROM b)
SELECT label, bin, round(lo + bin * w, 6) AS bin_low, round(lo + (bin + 1) * w, 6) AS bin_high, count(*) AS n,
round(count(*) / (sum(count(*)) OVER (PARTITION BY label) * w), 6) AS density FROM f GROUP BY label, bin, w, lo""",
)
def _(spark, d):
    return rounded(histogram(scored(spark, d), "prob", 20, ["label"]), ["bin_low", "bin_high", "density"])


@query(
    "agg14_member_correlation",
    """SELECT 'l_quantity' AS member, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem
UNION ALL SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 6) FROM lineitem""",
)
def _(spark, d):
    return rounded(correlations(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"]), ["correlation"])


@query(
    "agg15_member_scores",
    _union(
        "SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem",
        ["l_discount", "l_tax"],
    ),
)
def _(spark, d):
    return rounded(member_scores(table(spark, d, "lineitem"), ["l_discount", "l_tax"]), ["mean", "std"])


@query(
    "agg16_global_quantiles",
    f"""WITH {TX} SELECT round(quantile_cont("TransactionAmt", 0.9), 6) AS amount_q90,
round(quantile_cont(dist1, 0.8), 6) AS dist_q80 FROM tx""",
)
def _(spark, d):
    tx = transactions(spark, d)
    q = exact_quantiles(tx, {"a": F.col("TransactionAmt"), "d": F.col("dist1")}, [0.8, 0.9])
    values = [(round(q["a"][1], 6), round(q["d"][0], 6))]
    return spark.createDataFrame(values, "amount_q90 double, dist_q80 double")


CONFUSION = """count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp"""


@query("agg17_confusion", f"WITH {SCORED} SELECT {CONFUSION} FROM scored")
def _(spark, d):
    return confusion(scored(spark, d))


@query("agg17_confusion_by_period", f"WITH {SCORED} SELECT period, {CONFUSION} FROM scored GROUP BY period")
def _(spark, d):
    return confusion(scored(spark, d, periods=True), group=["period"])


@query(
    "agg18_class_presence",
    """SELECT source, count(DISTINCT toxic) AS classes FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
)
def _(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count_distinct("toxic").alias("classes"))


@query(
    "agg19_domain_counts",
    """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT CAST(rn > n // 2 AS INTEGER) AS domain, count(*) AS n FROM o GROUP BY 1""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), "o_orderkey")
    return half_split(orders, "day", "o_orderkey").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set4_unknown_categories",
    """SELECT 'source' AS feature, source AS value FROM (SELECT DISTINCT source FROM documents)
WHERE source NOT IN (SELECT source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1)
UNION ALL SELECT 'lang', lang FROM (SELECT DISTINCT lang FROM documents) WHERE lang <> 'en'""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    toxic = table(spark, d, "labels").where("toxic = 1")
    codes = category_codes(docs.join(toxic, "doc_id", "left_semi"), ["source"]).unionByName(
        category_codes(docs.where("lang = 'en'"), ["lang"])
    )
    return unknown_categories(docs, ["source", "lang"], codes)
