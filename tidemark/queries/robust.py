"""Inputs that are easy to get wrong: NaN, keys that are no small numbers or repeat, wide
column families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import row_mean, row_sum, with_row_std
from tidemark.operators.features import category_codes, code_bytes, encode
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.splits import drift_periods, temporal_split
from tidemark.queries.base import query, table

WIDE = 45


@query(
    "agg16_quantiles_with_nan",
    """SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
FROM events WHERE event_id % 7 <> 0""",
)
def _(spark, d):
    """NaN is a missing value, not the greatest one."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    q = exact_quantiles(table(spark, d, "events"), {"value": value}, [0.25, 0.5, 0.75])["value"]
    return spark.createDataFrame([tuple(q)], "q25 double, q50 double, q75 double")


def _periods_sql(key: str) -> str:
    return f"""SELECT o_orderkey, CAST(least((row_number() OVER (ORDER BY o_orderdate, {key}) - 1) // (count(*) OVER () // 4), 3) AS INTEGER)
AS period FROM orders"""


@query("spl2_timestamp_and_string_key", _periods_sql("CAST(o_orderkey AS VARCHAR)"))
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("k"))
    return drift_periods(orders, "o_orderdate", "k", 4).select("o_orderkey", "period")


@query("spl2_wide_decimal_key", _periods_sql("o_orderkey"))
def _(spark, d):
    wide = (F.col("o_orderkey").cast("decimal(38,0)") * F.lit("100000000000000000000").cast("decimal(21,0)")).cast("decimal(38,0)")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", wide.alias("k"))
    return drift_periods(orders, "o_orderdate", "k", 4).select("o_orderkey", "period")


@query(
    "spl1_repeated_keys",
    """WITH n AS (SELECT count(*) AS n FROM lineitem), c AS (SELECT CAST(n * 0.7 AS DOUBLE) AS a, n * (0.7 + 0.15) AS b, n FROM n)
SELECT split, n FROM (SELECT 'train' AS split, CAST(floor(a) AS BIGINT) AS n FROM c UNION ALL
SELECT 'val', CAST(floor(b) - floor(a) AS BIGINT) FROM c UNION ALL SELECT 'test', CAST(n - floor(b) AS BIGINT) FROM c)""",
)
def _(spark, d):
    """Few times and few keys, each held by thousands of rows: sizes stay exact."""
    split = temporal_split(table(spark, d, "lineitem"), "l_quantity", "l_linenumber")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _wide(i: int) -> str:
    return f"CASE WHEN (l_partkey + {i}) % 5 = 0 THEN NULL ELSE CAST((l_quantity * {i + 1} + l_suppkey) % 97 AS DOUBLE) END"


@query(
    "prj13_wide_family",
    f"""WITH w AS (SELECT l_orderkey, l_linenumber, [{", ".join(_wide(i) for i in range(WIDE))}] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(list_aggregate(v, 'sum'), 0), 6) AS v_sum, round(list_aggregate(v, 'avg'), 6) AS v_mean,
round(list_aggregate(v, 'stddev_samp'), 6) AS v_std FROM w""",
)
def _(spark, d):
    names = [f"V{i}" for i in range(WIDE)]
    lines = table(spark, d, "lineitem")
    wide = lines.select("l_orderkey", "l_linenumber", *[F.expr(_wide(i)).alias(n) for i, n in enumerate(names)])
    values = {"v_sum": row_sum(names), "v_mean": row_mean(names), "v_std": F.col("v_std")}
    out = with_row_std(wide, names, "v_std")
    return out.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(n) for n, v in values.items()])


MANY = 400


def _one(i: int) -> str:
    """One of many columns: fractions, whole numbers, few values, and NULLs."""
    return (
        f"CASE WHEN (event_id + {i}) % 7 <> 0 THEN CAST("
        + [f"value * {i + 1}", f"(event_id * {i + 3} + user_id) % 101", f"user_id % {i % 5 + 1}", f"value - {i}"][i % 4]
        + " AS DOUBLE) END"
    )


@query(
    "agg5_quartiles_of_400_columns",
    f"""WITH q AS (SELECT {", ".join(f"quantile_cont({_one(i)}, [0.25, 0.5, 0.75]) AS c{i}" for i in range(MANY))} FROM events),
u AS (UNPIVOT q ON {", ".join(f"c{i}" for i in range(MANY))} INTO NAME feature VALUE v)
SELECT feature, round(v[1], 6) AS q25, round(v[2], 6) AS q50, round(v[3], 6) AS q75 FROM u""",
)
def _(spark, d):
    """Exact quartiles of hundreds of columns in one plan."""
    many = {f"c{i}": F.expr(_one(i)) for i in range(MANY)}
    found = exact_quantiles(table(spark, d, "events"), many, [0.25, 0.5, 0.75])
    rows = [(c, *(round(v, 6) for v in q)) for c, q in found.items()]
    return spark.createDataFrame(rows, "feature string, q25 double, q50 double, q75 double")


@query(
    "jn3_fitted_codes_join",
    """WITH codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_type AS v FROM events WHERE user_id % 2 = 0))
SELECT event_id, CAST(coalesce(code, 0) AS INTEGER) AS event_type FROM events LEFT JOIN codes ON event_type = v""",
)
def _(spark, d):
    """Codes fitted on some users' events, joined to all events."""
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    codes = category_codes(events.where("user_id % 2 = 0"), ["event_type"])
    return encode(events, ["event_type"], codes, code_bytes(codes), {}).select("event_id", "event_type")
