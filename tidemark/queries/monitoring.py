"""Extensions: drift-weighted members, disagreement, retraining trigger, live monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.ensemble import disagreement, stability_weights
from tidemark.operators.stability import period_metrics
from tidemark.queries.base import CURVE, query, r6, rounded, table
from tidemark.queries.calibration import MEMBERS, MEMBERS_SQL, member_rows
from tidemark.session import scratch_path
from tidemark.streaming.monitor import monitor, period_flags, read_scored_stream, retrain_threshold, run_available

SPREAD = """sqrt((pow(m1 - (m1 + m2 + m3) / 3, 2) + pow(m2 - (m1 + m2 + m3) / 3, 2) + pow(m3 - (m1 + m2 + m3) / 3, 2)) / 3)"""


@query("ext2_disagreement", f"WITH {MEMBERS_SQL} SELECT key, round({SPREAD}, 6) AS disagreement FROM members")
def _(spark, d):
    return member_rows(spark, d).select("key", r6(disagreement(MEMBERS)).alias("disagreement"))


@query(
    "ext1_stability_weights",
    f"""WITH {MEMBERS_SQL}, long AS (UNPIVOT members ON m1, m2, m3 INTO NAME member VALUE p),
scored AS (SELECT member || '/' || period AS gp, label, p AS prob FROM long),
{CURVE.format(g="gp")},
a AS (SELECT split_part(g, '/', 1) AS member, sum(neg * (tp - pos) + 0.5::DOUBLE * pos * neg) / max(n_pos * n_neg) AS auc FROM cum GROUP BY g),
s AS (SELECT member, avg(auc) AS m, stddev_pop(auc) AS sd FROM a GROUP BY member),
w AS (SELECT member, m * (1 - sd) AS raw FROM s)
SELECT member, round(raw / sum(raw) OVER (), 6) AS weight FROM w""",
)
def _(spark, d):
    rows = member_rows(spark, d, periods=True)
    pairs = F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("prob")) for m in MEMBERS])
    long = rows.select("label", "period", F.explode(pairs).alias("m")).select("label", "period", "m.*")
    keyed = long.select("label", "prob", F.concat_ws("/", "member", F.col("period").cast("string")).alias("g"))
    per = period_metrics(keyed, period="g").withColumn("member", F.split("g", "/")[0])
    return rounded(stability_weights(per), ["weight"]).select("member", "weight")


@query(
    "ext3_retraining_trigger",
    f"""WITH {MEMBERS_SQL}, q AS (SELECT quantile_cont({SPREAD}, 0.9) AS t FROM members WHERE period = 0)
SELECT period, count(*) AS n, round(avg(CAST({SPREAD} > t AS INTEGER)), 6) AS uncertain_share,
avg(CAST({SPREAD} > t AS INTEGER)) > 0.1 AS retrain FROM members, q GROUP BY period""",
)
def _(spark, d):
    rows = member_rows(spark, d, periods=True).withColumn("prob", (F.col("m1") + F.col("m2") + F.col("m3")) / 3)
    threshold = retrain_threshold(rows.where("period = 0"), MEMBERS, 0.9)
    out = period_flags(rows, "period", MEMBERS, threshold).select("period", "n", "uncertain_share", "retrain")
    return rounded(out, ["uncertain_share"])


@query(
    "ext4_streaming_monitor",
    """WITH e AS (SELECT ts, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS prob FROM events),
w AS (SELECT CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, count(*) AS n, avg(prob) AS m FROM e GROUP BY 1)
SELECT day, n, round(m, 6) AS mean_score, m > 0.4 AS retrain FROM w
WHERE (day + 1) * 86400e6 <= (SELECT max(epoch_us(ts)) - 3600e6 FROM e)""",
)
def _(spark, d):
    """Every day the watermark has closed; the day still open is not reported yet."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = read_scored_stream(spark, d, schema, "events.parquet").select(
        "ts", F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("prob")
    )
    base = scratch_path(spark, f"monitor-{uuid.uuid4().hex}")
    out = run_available(monitor(rows, "ts", score_threshold=0.4), f"{base}/windows", f"{base}/state")
    day = F.floor(F.unix_seconds("window_start") / 86_400).alias("day")
    return out.select(day, "n", r6("mean_score").alias("mean_score"), "retrain")


@query("ext4_monitor_as_table", """WITH e AS (SELECT ts, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS prob FROM events)
SELECT CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, count(*) AS n, round(avg(prob), 6) AS mean_score FROM e GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "events").select("ts", F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("prob"))
    day = F.floor(F.unix_seconds("window_start") / 86_400).alias("day")
    return monitor(rows, "ts").select(day, "n", r6("mean_score").alias("mean_score"))
