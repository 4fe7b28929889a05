"""What jobs write is read back: source folders, saved ensembles and runs, reports, results.
The learners are logistic regressions at their defaults, since the files are what is tested."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.ensemble import Ensemble
from tidemark.operators.splits import half_split
from tidemark.params import EvalParams, Roles, TrainParams
from tidemark.plans.train import DriftAwareScorer, train, train_and_test
from tidemark.queries.base import TX, query, transactions
from tidemark.queries.drift_models import engineered
from tidemark.session import scratch_path, write_table
from tidemark.sources.readers import load_data
from tidemark.sources.sinks import read_json, read_metrics, write_report

ROLES = Roles()
PARAMS = TrainParams(members={"logreg": {"type": "logreg"}}, drift_learner="logreg")


def folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query(
    "src3_source_dispatch",
    f"""WITH {TX}, r AS (SELECT *, row_number() OVER (ORDER BY "TransactionDT", "TransactionID") AS i, count(*) OVER () AS n FROM tx),
s AS (SELECT *, CASE WHEN i <= n // 2 THEN 'train' ELSE 'test' END AS source FROM r)
SELECT source, count(*) AS n, count("ProductCD") AS with_identity, sum("isFraud")::BIGINT AS frauds, round(sum("TransactionAmt"), 4) AS amount,
sum(floor("TransactionDT" / 3600)::BIGINT % 24)::BIGINT AS hours FROM s GROUP BY source""",
)
def _(spark, d):
    """Train and test folders of two tables each, written here and loaded by name."""
    at = folder(spark, "source")
    halves = half_split(transactions(spark, d), ROLES.time, ROLES.key)
    for name, domain in (("train", 0), ("test", 1)):
        own = halves.where(F.col("domain") == domain).drop("domain")
        identity = ["ProductCD", "DeviceType"]
        own.drop(*identity).write.parquet(f"{at}/{name}_transaction")
        own.where(F.col("ProductCD").isNotNull()).select(ROLES.key, *identity).write.parquet(f"{at}/{name}_identity")
    parts = []
    for name, df in zip(("train", "test"), load_data(spark, at, fmt="parquet")):
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("n"),
                F.count("ProductCD").alias("with_identity"),
                F.sum(F.col("isFraud").cast("long")).alias("frauds"),
                F.round(F.sum("TransactionAmt"), 4).alias("amount"),
                F.sum(F.col("hour").cast("long")).alias("hours"),
            ).withColumn("source", F.lit(name))
        )
    return parts[0].unionByName(parts[1])


@query("snk1_saved_ensemble", "SELECT count(*) AS n, count(*) AS equal, TRUE AS same_weights, TRUE AS scores_vary FROM events")
def _(spark, d):
    rows, columns = engineered(spark, d)
    halves = half_split(rows, ROLES.time, ROLES.key)
    ensemble = Ensemble(PARAMS.members)
    ensemble.fit(halves.where("domain = 0"), halves.where("domain = 1"), columns, ROLES.label, ROLES.key)
    at = folder(spark, "ensemble")
    ensemble.save(at)
    again = Ensemble.load(spark, at)
    first, second = (write_table(m.predict(rows).select(ROLES.key, "prob"), "scores") for m in (ensemble, again))
    both = first.join(second.withColumnRenamed("prob", "again"), ROLES.key)
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("prob") == F.col("again")).alias("equal"),
        F.lit(again.weights == ensemble.weights).alias("same_weights"),
        (F.max("prob") > F.min("prob")).alias("scores_vary"),
    )


@query("snk3_published_runs", "SELECT count(*) AS n, count(*) AS equal, TRUE AS latest_is_second, TRUE AS first_still_loads, TRUE AS scores_vary FROM events")
def _(spark, d):
    """Two runs saved one after the other: the second is the latest, both load (SNK4)."""
    tx = write_table(transactions(spark, d), "raw-rows")
    scorer, _ = train(tx, ROLES, PARAMS)
    at = folder(spark, "runs")
    first, second = scorer.save(at, PARAMS), scorer.save(at, PARAMS)
    again, before = DriftAwareScorer.load(spark, at), DriftAwareScorer.load(spark, at, first)
    scored = [write_table(s.predict(tx).select(ROLES.key, F.col("prob").alias(n)), "scores") for s, n in ((scorer, "a"), (again, "b"))]
    both = scored[0].join(scored[1], ROLES.key)
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a") == F.col("b")).alias("equal"),
        F.lit(read_json(spark, f"{at}/latest.json")["run_id"] == second != first).alias("latest_is_second"),
        F.lit(before.ensemble.weights == scorer.ensemble.weights).alias("first_still_loads"),
        (F.max("a") > F.min("a")).alias("scores_vary"),
    )


@query("snk6_final_results", "SELECT TRUE AS tested, TRUE AS same_as_returned, TRUE AS targets_judged, TRUE AS settings_kept, TRUE AS run_saved")
def _(spark, d):
    """Train on the early half, test on the late one; every result file is read back."""
    halves = half_split(transactions(spark, d), ROLES.time, ROLES.key)
    at = folder(spark, "results")
    early, late = (halves.where(F.col("domain") == i).drop("domain") for i in (0, 1))
    _, final = train_and_test(early, late, ROLES, PARAMS, EvalParams(), out=at)
    returned = {(r["scope"], r["metric"]): r["value"] for r in final.collect()}
    stored = {(r["scope"], r["metric"]): r["value"] for r in spark.read.json(f"{at}/results/metrics").collect()}
    targets = spark.read.json(f"{at}/results/targets").collect()
    config = read_json(spark, f"{at}/results/config")
    run_id = read_json(spark, f"{at}/latest.json")["run_id"]
    facts = {
        "tested": ("test", "test_auroc") in stored,
        "same_as_returned": {k: v for k, v in stored.items() if v is not None} == {k: v for k, v in returned.items() if v is not None},
        "targets_judged": {t["metric"] for t in targets} == set(EvalParams().targets) and all(t["met"] in (True, False) for t in targets),
        "settings_kept": config["params"]["seed"] == PARAMS.seed and config["roles"]["time"] == ROLES.time,
        "run_saved": read_metrics(spark, f"{at}/metrics", run_id).count() > 0,
    }
    return spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} boolean" for k in facts))


@query(
    "snk7_evaluation_report",
    f"""WITH {TX}, s AS (SELECT "isFraud" AS y, CASE WHEN "TransactionAmt" > 50 THEN 1 ELSE 0 END AS pred FROM tx),
m AS (SELECT count(*) FILTER (y = 1 AND pred = 1)::DOUBLE AS true_positives, count(*) FILTER (y = 0 AND pred = 1)::DOUBLE AS false_positives,
  round(avg((y = pred)::INTEGER), 6) AS accuracy FROM s)
SELECT metric, value, true AS in_summary FROM (UNPIVOT m ON true_positives, false_positives, accuracy INTO NAME metric VALUE value)""",
)
def _(spark, d):
    """The report's metric rows, and whether its text has each of them."""
    rows = transactions(spark, d).select(F.col("isFraud").alias("y"), (F.col("TransactionAmt") > 50).cast("int").alias("pred"))
    found = rows.agg(
        F.sum(F.expr("int(y = 1 AND pred = 1)")).cast("double").alias("true_positives"),
        F.sum(F.expr("int(y = 0 AND pred = 1)")).cast("double").alias("false_positives"),
        F.round(F.avg(F.expr("int(y = pred)")), 6).alias("accuracy"),
    )
    long = found.unpivot([], ["true_positives", "false_positives", "accuracy"], "metric", "value")
    at = folder(spark, "report")
    write_report(long, at)
    lines = [r["value"].strip() for r in spark.read.text(f"{at}/summary").collect()]
    written = spark.read.json(f"{at}/metrics")
    told = F.array(*[F.lit(line) for line in lines])
    line = F.concat("metric", F.lit(": "), F.format_string("%.6f", "value"))
    return written.select("metric", "value", F.array_contains(told, line).alias("in_summary"))
