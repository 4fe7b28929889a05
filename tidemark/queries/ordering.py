"""Windows, positions, splits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import safe_div
from tidemark.operators.order import row_index
from tidemark.operators.ranking import cumulative_points, equal_count_bins
from tidemark.operators.splits import (
    class_positions,
    drift_periods,
    half_split,
    random_holdout,
    stratified_folds,
    stratified_temporal_split,
    temporal_split,
)
from tidemark.operators.velocity import time_since_previous, with_velocity
from tidemark.queries.base import CURVE, ORDER_ROWS, SCORED, TX, order_rows, query, r6, scored, table, transactions

LAGGED = """"TransactionDT" - lag("TransactionDT") OVER (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID")"""


@query("win1_time_since_previous", f"""WITH {TX} SELECT "TransactionID", round({LAGGED}, 5) AS time_diff FROM tx""")
def _(spark, d):
    tx = transactions(spark, d).select("TransactionID", "TransactionDT", "card1")
    out = time_since_previous(tx, "card1", "TransactionDT", "TransactionID")
    return out.select("TransactionID", F.round("time_diff", 5).alias("time_diff"))


@query("win2_velocity", f"""WITH {TX} SELECT "TransactionID", round(1 / ({LAGGED} + 1), 6) AS velocity FROM tx""")
def _(spark, d):
    tx = transactions(spark, d).select("TransactionID", "TransactionDT", "card1")
    out = with_velocity(tx, "card1", "TransactionDT", "TransactionID")
    return out.select("TransactionID", r6("velocity").alias("velocity"))


@query(
    "win2_velocity_split_hot_cards",
    """SELECT l_orderkey, l_linenumber, 1.0::DOUBLE / (l_quantity - lag(l_quantity) OVER (
  PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey * 10 + l_linenumber) + 1) AS velocity FROM lineitem""",
)
def _(spark, d):
    """Three cards hold all rows and times repeat thousands of times: the chunked path."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_quantity",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key"),
    )
    out = with_velocity(rows, "l_returnflag", "l_quantity", "line_key", hot_rows=2_000)
    return out.select("l_orderkey", "l_linenumber", "velocity")


@query(
    "win3_time_position",
    f"WITH {ORDER_ROWS} SELECT o_orderkey, row_number() OVER (ORDER BY time, o_orderkey) AS position FROM o",
)
def _(spark, d):
    return row_index(order_rows(spark, d).select("o_orderkey", "time"), ["time", "o_orderkey"]).drop("time")


@query(
    "win4_class_position",
    f"""WITH {ORDER_ROWS} SELECT o_orderkey, label,
row_number() OVER (PARTITION BY label ORDER BY time, o_orderkey) AS class_position FROM o""",
)
def _(spark, d):
    rows = order_rows(spark, d).select("o_orderkey", "time", "label")
    return class_positions(rows, "time", "o_orderkey", "label").drop("time")


@query(
    "win5_cumulative_counts",
    f"""WITH {SCORED}, {CURVE.format(g="period")} SELECT g AS period, round(score, 6) AS score, tp, fp, n_pos, n_neg FROM cum""",
)
def _(spark, d):
    c = cumulative_points(scored(spark, d, periods=True), group=["period"])
    return c.select("period", r6("score").alias("score"), "tp", "fp", "n_pos", "n_neg")


@query(
    "win5_cumulative_counts_bucketed",
    f"""WITH {SCORED}, {CURVE.format(g="0")} SELECT round(score, 6) AS score, tp, fp, n_pos, n_neg FROM cum""",
)
def _(spark, d):
    c = cumulative_points(scored(spark, d), rows_per_bucket=500)
    return c.select(r6("score").alias("score"), "tp", "fp", "n_pos", "n_neg")


@query(
    "win6_equal_count_bins",
    f"""WITH {SCORED}, b AS (SELECT *, least((row_number() OVER (ORDER BY prob, key) - 1) // (count(*) OVER () // 10), 9) AS bin FROM scored)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, sum(label)::BIGINT AS positives, round(sum(prob), 5) AS expected,
max(key) AS last_key FROM b GROUP BY bin""",
)
def _(spark, d):
    return (
        equal_count_bins(scored(spark, d), "prob", "key", 10)
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("label").alias("positives"),
            F.round(F.sum("prob"), 5).alias("expected"),
            F.max("key").alias("last_key"),
        )
    )


@query("srt1_time_order", f"WITH {ORDER_ROWS} SELECT o_orderkey, time, o_totalprice FROM o ORDER BY time, o_orderkey")
def _(spark, d):
    return order_rows(spark, d).select("o_orderkey", "time", "o_totalprice").orderBy("time", "o_orderkey")


@query(
    "top3_nearest_point",
    f"""WITH {SCORED}, {CURVE.format(g="period")}
SELECT g AS period, round(arg_min(score, [abs(fp / n_neg - 0.25), -score]), 6) AS score FROM cum GROUP BY g""",
)
def _(spark, d):
    c = cumulative_points(scored(spark, d, periods=True), group=["period"])
    distance = F.abs(safe_div("fp", "n_neg") - F.lit(0.25))
    return c.groupBy("period").agg(r6(F.min_by("score", F.struct(distance, -F.col("score")))).alias("score"))


SPLIT = """CASE WHEN rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
WHEN rn <= CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END"""


@query(
    "spl1_temporal_split",
    f"""WITH {ORDER_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY time, o_orderkey) AS rn, count(*) OVER () AS n FROM o)
SELECT o_orderkey, {SPLIT} AS split FROM r""",
)
def _(spark, d):
    rows = order_rows(spark, d)
    return temporal_split(rows, "time", "o_orderkey", (0.7, 0.15, 0.15)).select("o_orderkey", "split")


@query(
    "spl2_drift_periods",
    f"""WITH {ORDER_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY time, o_orderkey) AS rn, count(*) OVER () AS n FROM o)
SELECT o_orderkey, CAST(least((rn - 1) // (n // 7), 6) AS INTEGER) AS period FROM r""",
)
def _(spark, d):
    return drift_periods(order_rows(spark, d), "time", "o_orderkey", 7).select("o_orderkey", "period")


@query(
    "spl2_drift_periods_narrowed",
    """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS rn,
  count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(least((rn - 1) // (n // 5), 4) AS INTEGER) AS period FROM r""",
)
def _(spark, d):
    """Few candidates allowed, so each cut is found by narrowing brackets."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.unix_date(F.col("l_shipdate").cast("date")).alias("day"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key"),
    )
    out = drift_periods(rows, "day", "line_key", 5, candidates=100)
    return out.select("l_orderkey", "l_linenumber", "period")


@query(
    "spl3_stratified_split",
    f"""WITH {ORDER_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY time, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM o)
SELECT o_orderkey, label, CASE WHEN rn <= CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def _(spark, d):
    rows = order_rows(spark, d)
    return stratified_temporal_split(rows, "time", "o_orderkey", "label", 0.8).select("o_orderkey", "label", "split")


@query(
    "spl4_half_split",
    f"""WITH {ORDER_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY time, o_orderkey) AS rn, count(*) OVER () AS n FROM o)
SELECT o_orderkey, CAST(rn > n // 2 AS INTEGER) AS domain FROM r""",
)
def _(spark, d):
    return half_split(order_rows(spark, d), "time", "o_orderkey").select("o_orderkey", "domain")


HASH = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT)"


@query("spl5_random_holdout", f"SELECT o_orderkey, CAST({HASH} % 10000 < 2000 AS INTEGER) AS holdout FROM orders")
def _(spark, d):
    return random_holdout(order_rows(spark, d), "o_orderkey", 0.2, 42).select("o_orderkey", "holdout")


@query(
    "spl6_stratified_folds",
    f"""WITH {ORDER_ROWS}, r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {HASH}, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM o)
SELECT o_orderkey, label, CAST(rn > n // 3 AS INTEGER) + CAST(rn > 2 * n // 3 AS INTEGER) AS fold FROM r""",
)
def _(spark, d):
    return stratified_folds(order_rows(spark, d), "label", "o_orderkey", 3, 42).select("o_orderkey", "label", "fold")
