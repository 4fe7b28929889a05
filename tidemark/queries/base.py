"""Registry, and the driver tables seen as transaction tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import pick
from tidemark.operators.splits import drift_periods
from tidemark.sources.readers import epoch_seconds, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, so that summation order cannot show."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the transaction table and ``customer`` as its identity table."""
    events = table(spark, sf_dir, "events")
    customer = table(spark, sf_dir, "customer")
    joined = events.join(customer, events["user_id"] == customer["c_custkey"], "left")
    return joined.select(
        F.col("event_id").alias("TransactionID"),
        epoch_seconds("ts").alias("TransactionDT"),
        F.col("value").alias("TransactionAmt"),
        F.col("user_id").alias("card1"),
        F.col("c_nationkey").alias("card2"),
        F.col("c_mktsegment").alias("ProductCD"),
        F.when(F.col("c_nationkey") < 10, "mobile").otherwise("desktop").alias("DeviceType"),
        F.col("c_acctbal").alias("dist1"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("dist2"),
        (F.col("event_type") == "error").cast("int").alias("isFraud"),
    )


TX = """tx AS (
  SELECT event_id AS "TransactionID", epoch_us(ts) / 1e6 AS "TransactionDT",
         value AS "TransactionAmt", user_id AS card1, c_nationkey AS card2,
         c_mktsegment AS "ProductCD",
         CASE WHEN c_nationkey < 10 THEN 'mobile' ELSE 'desktop' END AS "DeviceType",
         c_acctbal AS dist1, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS dist2,
         CAST(event_type = 'error' AS INTEGER) AS "isFraud"
  FROM events LEFT JOIN customer ON user_id = c_custkey)"""

PERIODS = 5


def scored(spark: SparkSession, sf_dir: str, periods: bool = False) -> DataFrame:
    """(key, label, prob, pred[, period]): a deterministic score with many ties."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"),
        epoch_seconds("ts").alias("time"),
        F.col("user_id").alias("user_id"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("prob"),
    )
    out = events.withColumn("pred", pick(0.5))
    return drift_periods(out, "time", "key", PERIODS) if periods else out


SCORED = """scored AS (
  SELECT event_id AS key, epoch_us(ts) / 1e6 AS time, user_id,
         CAST(event_type = 'error' AS INTEGER) AS label,
         least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS prob,
         CAST(least(value / 100.0::DOUBLE, 1.0::DOUBLE) > 0.5 AS INTEGER) AS pred,
         CAST(least((row_number() OVER (ORDER BY ts, event_id) - 1)
              // (count(*) OVER () // 5), 4) AS INTEGER) AS period
  FROM events)"""

# Cumulative points per group; the caller names the group column in the format.
CURVE = """pts AS (
  SELECT {g} AS g, prob AS score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg
  FROM scored GROUP BY 1, 2),
cum AS (
  SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY score DESC) AS tp,
         sum(neg) OVER (PARTITION BY g ORDER BY score DESC) AS fp,
         sum(pos) OVER (PARTITION BY g) AS n_pos, sum(neg) OVER (PARTITION BY g) AS n_neg
  FROM pts)"""

LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity,
         CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS c1, l_linenumber AS c2,
         CASE WHEN l_linestatus <> 'O' THEN l_suppkey END AS d1, l_partkey AS d2,
         CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS v1,
         CASE WHEN l_returnflag <> 'R' OR l_linestatus = 'F' THEN l_discount END AS v2,
         l_tax AS v3
  FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its numbers as the C, D and V families, some of them NULL."""
    df = table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        F.when(flag != "N", F.col("l_quantity")).alias("C1"),
        F.col("l_linenumber").alias("C2"),
        F.when(status != "O", F.col("l_suppkey")).alias("D1"),
        F.col("l_partkey").alias("D2"),
        F.when(flag != "R", F.col("l_extendedprice")).alias("V1"),
        F.when((flag != "R") | (status == "F"), F.col("l_discount")).alias("V2"),
        F.col("l_tax").alias("V3"),
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` by day: many equal times, so every cut falls inside a run of ties."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        epoch_seconds("o_orderdate").alias("time"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        "o_totalprice",
    )


ORDER_ROWS = """o AS (
  SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS time,
         CAST(o_orderstatus = 'F' AS INTEGER) AS label, o_totalprice
  FROM orders)"""
