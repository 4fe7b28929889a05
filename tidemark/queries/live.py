"""Metrics that are kept up to date, and live per-card state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tidemark.operators.score_state import add_batch, compact, state_confusion, state_metrics, state_points
from tidemark.queries.base import PERIODS, SCORED, query, r6, rounded, scored
from tidemark.queries.ranking import AP, AUC, BY_PERIOD, CURVE
from tidemark.session import scratch_path
from tidemark.streaming.monitor import read_scored_stream
from tidemark.streaming.velocity import keep_scores, live_time_since_previous

METRICS = ["auc", "average_precision", "fraud_rate"]
SUMMARY = f"round({AUC}, 6) AS auc, round({AP}, 6) AS average_precision, round(max(n_pos / (n_pos + n_neg)), 6) AS fraud_rate"


def period_state(spark, d) -> str:
    """The state after every period came as a batch of its own and one of them twice."""
    rows = scored(spark, d, periods=True)
    path = scratch_path(spark, f"score-state-{uuid.uuid4().hex}")
    for period in [*range(PERIODS), 2]:
        add_batch(rows.where(F.col("period") == period), path, period)
    return path


@query("met13_incremental_period_metrics", f"{BY_PERIOD} SELECT g AS period, {SUMMARY} FROM cum GROUP BY g")
def _(spark, d):
    """Small batches folded into one, and the metrics from what is kept."""
    path = period_state(spark, d)
    folded = scratch_path(spark, f"score-state-{uuid.uuid4().hex}")
    compact(spark, path, folded, IntegerType(), PERIODS - 2)
    return rounded(state_metrics(state_points(spark, folded, IntegerType())), METRICS)


@query(
    "agg17_incremental_confusion",
    f"""WITH {SCORED} SELECT period, t AS threshold,
count(*) FILTER (WHERE label = 1 AND prob > t) AS tp, count(*) FILTER (WHERE label = 0 AND prob > t) AS fp,
count(*) FILTER (WHERE label = 1 AND prob <= t) AS fn, count(*) FILTER (WHERE label = 0 AND prob <= t) AS tn
FROM scored, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS t) WHERE period IN (1, 3) GROUP BY 1, 2""",
)
def _(spark, d):
    """Of two periods: their folders are all that is read."""
    points = state_points(spark, period_state(spark, d), IntegerType(), periods=[1, 3])
    return state_confusion(points, [0.25, 0.5, 0.75])


def live_events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return read_scored_stream(spark, d, schema, "events.parquet")


@query(
    "ext4_live_score_state",
    f"""WITH scored AS (SELECT CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, CAST(event_type = 'error' AS INTEGER) AS label,
least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS prob FROM events), {CURVE.format(g="day")}
SELECT g AS period, {SUMMARY} FROM cum GROUP BY g HAVING max(n_pos) > 0 AND max(n_neg) > 0""",
)
def _(spark, d):
    """A stream folded into the state batch by batch; the metrics of its days."""
    rows = live_events(spark, d).select(
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400).alias("period"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("prob"),
    )
    base = scratch_path(spark, f"live-{uuid.uuid4().hex}")
    keep_scores(rows, f"{base}/scores", f"{base}/progress")
    return rounded(state_metrics(state_points(spark, f"{base}/scores", LongType())), METRICS)


@query(
    "win1_live_time_since_previous",
    """WITH t AS (SELECT event_id, ts, CASE WHEN user_id IS NOT NULL THEN
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 END AS gap FROM events)
SELECT event_id, round(gap, 6) AS time_diff FROM t WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _(spark, d):
    """Every row that the watermark has passed."""
    base = scratch_path(spark, f"live-{uuid.uuid4().hex}")
    told = live_time_since_previous(live_events(spark, d), "user_id", "ts", "event_id")
    query = (
        told.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{base}/rows").select("event_id", r6("time_diff").alias("time_diff"))
