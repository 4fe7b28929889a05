"""Sources, sinks and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.classification import threshold_metrics
from tidemark.operators.joins import common_columns, left_join_identity, stack_domains
from tidemark.operators.profile import schema_profile
from tidemark.operators.splits import drift_periods, sample_rows
from tidemark.operators.stability import pair_periods
from tidemark.params import Roles
from tidemark.queries.base import ORDER_ROWS, SCORED, TX, order_rows, query, r6, rounded, scored, table, transactions
from tidemark.session import scratch_path
from tidemark.sources.readers import read_optional, read_table
from tidemark.sources.sinks import check_targets, read_metrics, union_metrics, wide_to_metrics, write_metrics, write_scores


@query("src1_typed_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    return read_table(spark, f"{d}/orders.parquet", schema=schema)


@query(
    "src2_optional_identity",
    "SELECT d.doc_id, lang, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    for name in ("labels", "identity_that_is_not_there"):
        identity = read_optional(spark, f"{d}/{name}.parquet")
        if identity is not None:
            docs = left_join_identity(docs, identity.select("doc_id", "quality"), "doc_id")
    return docs


@query(
    "src4_schema_profile",
    f"""WITH {TX}
SELECT c.column, c.kind, s.n_samples, CAST(8 AS BIGINT) AS n_features, s.fraud_rate
FROM (VALUES ('TransactionDT', 'numeric'), ('TransactionAmt', 'numeric'), ('card1', 'numeric'),
             ('card2', 'numeric'), ('dist1', 'numeric'), ('dist2', 'numeric'),
             ('ProductCD', 'categorical'), ('DeviceType', 'categorical')) c("column", kind)
CROSS JOIN (SELECT count(*) AS n_samples, round(avg("isFraud"), 6) AS fraud_rate FROM tx) s""",
)
def _(spark, d):
    return rounded(schema_profile(transactions(spark, d), Roles()), ["fraud_rate"])


@query(
    "src5_row_sample",
    """SELECT event_id, user_id, value FROM events
ORDER BY CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT), event_id LIMIT 500""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    return sample_rows(events, "event_id", 500, seed=42)


@query(
    "snk5_metric_rows",
    f"""WITH {SCORED}, m AS (
  SELECT count(*) FILTER (label = 1 AND pred = 1)::DOUBLE AS true_positives,
         count(*) FILTER (label = 0 AND pred = 1)::DOUBLE AS false_positives,
         count(*) FILTER (label = 1 AND pred = 0)::DOUBLE AS false_negatives,
         count(*) FILTER (label = 0 AND pred = 0)::DOUBLE AS true_negatives FROM scored)
SELECT 'test' AS scope, 'test_' || metric AS metric, value
FROM (UNPIVOT m ON true_positives, false_positives, false_negatives, true_negatives
      INTO NAME metric VALUE value)""",
)
def _(spark, d):
    counts = threshold_metrics(scored(spark, d)).select(
        "true_positives", "false_positives", "false_negatives", "true_negatives"
    )
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex}")
    write_metrics(wide_to_metrics(counts, "test", prefix="test_"), path, "run")
    return read_metrics(spark, path, "run").select("scope", "metric", "value")


@query("snk8_scored_rows", f"WITH {SCORED} SELECT key, round(prob, 6) AS prob, pred FROM scored")
def _(spark, d):
    path = scratch_path(spark, f"scores-{uuid.uuid4().hex}")
    write_scores(scored(spark, d).withColumn("prob", r6("prob")), path, "key")
    return spark.read.parquet(path)


@query(
    "jn1_left_outer",
    "SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return left_join_identity(docs, table(spark, d, "labels"), "doc_id")


@query(
    "jn1_duplicates_and_name_clash",
    """SELECT o_custkey AS cust, o.o_orderkey, o.o_totalprice AS amount_x, c.c_acctbal AS amount_y
FROM orders o LEFT JOIN (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_nationkey = 0) c
ON o_custkey = c_custkey""",
)
def _(spark, d):
    left = table(spark, d, "orders").select(
        F.col("o_custkey").alias("cust"), "o_orderkey", F.col("o_totalprice").alias("amount")
    )
    customer = table(spark, d, "customer")
    right = customer.unionByName(customer.where("c_nationkey = 0")).select(
        F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("amount")
    )
    return left_join_identity(left, right, "cust")


@query(
    "jn4_period_label_pairing",
    f"""WITH {SCORED} SELECT period, count(*) AS n, round(avg(prob), 6) AS mean_prob,
       round(avg(label), 6) AS label_rate FROM scored WHERE period <> 2 GROUP BY period""",
)
def _(spark, d):
    rows = scored(spark, d, periods=True)
    pairs = pair_periods(
        rows.select("period", "key", "prob"), rows.where("period <> 2").select("period", "key", "label")
    )
    return pairs.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("prob")).alias("mean_prob"),
        r6(F.avg("label")).alias("label_rate"),
    )


@query(
    "prj3_common_columns",
    """SELECT 0 AS domain, o_custkey AS cust, o_totalprice AS amount FROM orders
UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer""",
)
def _(spark, d):
    left = table(spark, d, "orders").select(
        F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("amount"), "o_orderstatus"
    )
    right = table(spark, d, "customer").select(
        "c_mktsegment", F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("cust")
    )
    shared = common_columns(left, right)
    return stack_domains(left.select(*shared), right.select(*shared))


@query(
    "set1_stack_domains",
    f"""WITH {TX}, n AS (SELECT count(*) AS n FROM tx),
p AS (SELECT *, row_number() OVER (ORDER BY "TransactionDT", "TransactionID") AS rn FROM tx)
SELECT CAST(rn > n.n // 2 AS INTEGER) AS domain, "TransactionID", "TransactionAmt", card1, "ProductCD"
FROM p, n""",
)
def _(spark, d):
    tx = transactions(spark, d).select(
        "TransactionID", "TransactionDT", "TransactionAmt", "card1", "ProductCD", "isFraud"
    )
    halves = drift_periods(tx, "TransactionDT", "TransactionID", 2)
    source, target = (halves.where(F.col("period") == i).drop("period", "TransactionDT") for i in (0, 1))
    roles = Roles()
    return stack_domains(source, target, roles.reserved(), (roles.key,))


@query(
    "set2_all_but_first_period",
    f"""WITH {ORDER_ROWS}, p AS (
  SELECT *, least((row_number() OVER (ORDER BY time, o_orderkey) - 1) // (count(*) OVER () // 5), 4) AS period FROM o)
SELECT o_orderkey, time, CAST(period AS INTEGER) AS period FROM p WHERE period > 0""",
)
def _(spark, d):
    periods = drift_periods(order_rows(spark, d), "time", "o_orderkey", 5)
    return periods.where(F.col("period") > 0).select("o_orderkey", "time", "period")


@query(
    "met22_target_check",
    f"""WITH {SCORED}, m AS (
  SELECT avg((prob - label) * (prob - label)) AS brier,
         count(*) FILTER (label = pred) * 1.0::DOUBLE / count(*) AS accuracy FROM scored)
SELECT t.metric, t.target, t.direction, round(v.value, 6) AS value,
       coalesce(CASE WHEN t.direction = 'lower' THEN v.value <= t.target ELSE v.value >= t.target END, false) AS met
FROM (VALUES ('accuracy', 0.5::DOUBLE, 'higher'), ('calibration_brier_score', 0.1::DOUBLE, 'lower'),
             ('auroc', 0.94::DOUBLE, 'higher')) t(metric, target, direction)
LEFT JOIN (SELECT 'accuracy' AS metric, accuracy AS value FROM m
           UNION ALL SELECT 'calibration_brier_score', brier FROM m) v ON t.metric = v.metric""",
)
def _(spark, d):
    rows = scored(spark, d)
    brier = rows.agg(F.avg(F.pow(F.col("prob") - F.col("label"), 2)).alias("calibration_brier_score"))
    metrics = union_metrics(
        [
            wide_to_metrics(threshold_metrics(rows).select("accuracy"), "test"),
            wide_to_metrics(brier, "test"),
        ]
    )
    targets = {
        "accuracy": (0.5, "higher"),
        "calibration_brier_score": (0.1, "lower"),
        "auroc": (0.94, "higher"),
    }
    return rounded(check_targets(metrics, targets), ["value"])
