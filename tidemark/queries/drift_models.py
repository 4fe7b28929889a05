"""Learned operators: domain classifiers, the ensemble and the jobs. They have no SQL form;
the tests check their invariants."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tidemark.operators.drift import DriftValidator, detection_metrics
from tidemark.operators.ensemble import Ensemble, disagreement
from tidemark.operators.features import FeatureEngineer
from tidemark.operators.learners import assemble, make_learner, weighted_mean
from tidemark.operators.splits import drift_periods, half_split
from tidemark.params import DEFAULT_MEMBERS, EvalParams, Roles, TrainParams
from tidemark.plans.train import DriftAwareScorer, evaluate, prepare, train
from tidemark.queries.base import TX, query, rounded, table, transactions
from tidemark.session import scratch_path, write_table

ROLES = Roles()

PARAMS = TrainParams()

# Fewer rounds, in drf1, drf4, drf8, drf9 and mdl6 only.
ROUNDS = 8
BOOST = {"rounds": ROUNDS}


def engineered(spark, d):
    """Engineered rows with their period, written once; the raw rows (a join) too, since every
    fit and cut reads them anew."""
    tx = raw_rows(spark, d)
    model = FeatureEngineer(ROLES, keep_profile=False).fit(tx)
    rows = drift_periods(tx, ROLES.time, ROLES.key, PARAMS.periods)
    columns = [c for c in model.feature_columns if c != ROLES.time]
    return write_table(model.transform(rows), "engineered"), columns


def raw_rows(spark, d):
    """The raw rows (a join), written once: training and scoring read them several times."""
    return write_table(transactions(spark, d), "raw-rows")


def trained(tx):
    return train(tx, ROLES, PARAMS)


@query("mdl13_end_to_end_training")
def _(spark, d):
    """Splits, features, members, calibration, weights, validators and all metrics."""
    return trained(transactions(spark, d))[1]


@query("mdl14_prepared_rows")
def _(spark, d):
    data = prepare(transactions(spark, d), ROLES, PARAMS)
    return data.rows.groupBy("split", "period").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ROLES.label).alias("fraud_rate"), F.avg("velocity").alias("mean_velocity")
    )


@query(
    "mdl14_split_and_period_sizes",
    f"""WITH {TX}, r AS (SELECT "isFraud" AS y, "TransactionDT" AS t, "TransactionID" AS k,
  row_number() OVER (PARTITION BY "isFraud" ORDER BY "TransactionDT", "TransactionID") AS rn, count(*) OVER (PARTITION BY "isFraud") AS c FROM tx),
s AS (SELECT *, CASE WHEN rn <= floor(c * {PARAMS.train_ratio}::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY t, k) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM s)
SELECT split, CAST(CASE WHEN split = 'train' THEN least(i // (n // 5), 4) END AS INTEGER) AS period, count(*) AS n,
round(avg(y), 9) AS fraud_rate FROM p GROUP BY 1, 2""",
)
def _(spark, d):
    data = prepare(transactions(spark, d), ROLES, PARAMS)
    return data.rows.groupBy("split", "period").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(ROLES.label).cast("double")), 9).alias("fraud_rate")
    )


@query("mdl11_valid_scores", "SELECT count(*) AS n, count(*) AS in_range, count(*) AS is_mean, count(*) AS pred_fits FROM events")
def _(spark, d):
    """Of all rows: scored, every probability within [0, 1], the weighted mean of the
    members, and the prediction its threshold."""
    tx = raw_rows(spark, d)
    scorer, _ = trained(tx)
    scored = scorer.predict(tx)
    members = [f"prob_{n}" for n in scorer.ensemble.models]
    mean = weighted_mean(members, [scorer.ensemble.weights[n] for n in scorer.ensemble.models])
    ranges = F.lit(True)
    for c in [*members, "prob"]:
        ranges = ranges & F.col(c).between(0.0, 1.0)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ranges).alias("in_range"),
        F.count_if(F.abs(F.col("prob") - mean) < 1e-12).alias("is_mean"),
        F.count_if((F.col("prob") > 0.5) == (F.col("pred") == 1)).alias("pred_fits"),
    )


@query("snk2_reloaded_scores", "SELECT count(*) AS n, count(*) AS equal FROM events")
def _(spark, d):
    """Save all artifacts, load them, and score every row with both."""
    tx = raw_rows(spark, d)
    scorer, _ = trained(tx)
    path = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    scorer.save(path, PARAMS)
    again = DriftAwareScorer.load(spark, path)
    first, second = (write_table(m.predict(tx).select(ROLES.key, "prob"), "scores") for m in (scorer, again))
    both = first.join(second.withColumnRenamed("prob", "again"), ROLES.key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob") == F.col("again")).alias("equal"))


@query("drf1_domain_classifier")
def _(spark, d):
    rows, columns = engineered(spark, d)
    first_vs_rest = rows.withColumn("domain", (F.col("period") > 0).cast("int"))
    found = DriftValidator("boost", params=BOOST).fit(first_vs_rest, columns, ROLES.key)
    return spark.createDataFrame(list(found.items()), "metric string, value double")


@query("drf2_predict_drift")
def _(spark, d):
    rows, columns = engineered(spark, d)
    domains = rows.withColumn("domain", (F.col("period") > 0).cast("int"))
    validator = DriftValidator("boost", params={"rounds": PARAMS.drift_rounds})
    validator.fit(domains, columns, ROLES.key)
    return validator.predict_drift(domains)


@query("drf3_top1_drift_features")
def _(spark, d):
    rows, columns = engineered(spark, d)
    validator = DriftValidator("rf", params={"numTrees": 10, "maxDepth": 5})
    validator.fit(half_split(rows, ROLES.time, ROLES.key), columns, ROLES.key)
    return validator.top_features(spark, 10)


@query("drf4_learner_types")
def _(spark, d):
    rows, columns = engineered(spark, d)
    halves = half_split(rows, ROLES.time, ROLES.key)
    out = []
    # All four read the same rows, assembled once.
    ready = DriftValidator().rows(halves, columns, ROLES.key).persist(StorageLevel.MEMORY_AND_DISK)
    for kind, params in (("boost", BOOST), ("gbt", {"maxIter": ROUNDS}), ("rf", {"numTrees": 10, "maxDepth": 5}), ("logreg", {})):
        found = DriftValidator(kind, params=params).fit(halves, columns, ROLES.key, ready=ready)
        out += [(kind, name, value) for name, value in found.items()]
    ready.unpersist()
    return spark.createDataFrame(out, "learner string, metric string, value double")


@query("drf6_raw_drift_evaluation")
def _(spark, d):
    tx = raw_rows(spark, d)
    scorer, _ = trained(tx)
    halves = half_split(tx, ROLES.time, ROLES.key)
    return scorer.evaluate_drift(halves.where("domain = 1").drop("domain"), halves.where("domain = 0").drop("domain"))


@query("drf8_model_detection")
def _(spark, d):
    rows, columns = engineered(spark, d)
    validator = DriftValidator("boost", params=BOOST)
    validator.fit(rows.withColumn("domain", (F.col("period") > 0).cast("int")), columns, ROLES.key)
    return detection_metrics(validator.period_scores(rows.where(F.col("period") > 0)))


@query("drf9_halves_validator")
def _(spark, d):
    """Early half against late half, fitted here."""
    rows, columns = engineered(spark, d)
    found = DriftValidator("boost", params=BOOST).fit(half_split(rows, ROLES.time, ROLES.key), columns, ROLES.key)
    return spark.createDataFrame([(f"adversarial_{k}", v) for k, v in found.items()], "metric string, value double")


@query("mdl6_member_metrics")
def _(spark, d):
    rows, columns = engineered(spark, d)
    halves = half_split(rows, ROLES.time, ROLES.key)
    ensemble = Ensemble(PARAMS.members, max_rounds=ROUNDS, calibrate=False)
    found = ensemble.fit(halves.where("domain = 0"), halves.where("domain = 1"), columns, ROLES.label, ROLES.key)
    return spark.createDataFrame(list(found.items()), "metric string, value double")


@query(
    "mdl7_early_stopping",
    "SELECT count(*) AS n, TRUE AS stopped, TRUE AS best_is_lowest, TRUE AS grew_no_more, TRUE AS learned FROM events",
)
def _(spark, d):
    """The default leaf-wise member with its default patience and up to 1,000 rounds: it stops,
    keeps the trees up to the lowest loss, and grew exactly ``patience`` more."""
    rows, columns = engineered(spark, d)
    halves = assemble(half_split(rows, ROLES.time, ROLES.key), columns).select(ROLES.key, "features", ROLES.label, "domain")
    config = DEFAULT_MEMBERS["boost_leafwise"]
    learner = make_learner("boost", ROLES.label, 42, {**config["params"], "rounds": TrainParams().max_rounds})
    patience = config["early_stopping"]
    model = learner.fit(halves.where("domain = 0"), halves.where("domain = 1"), patience)
    facts = (
        model.grown < learner.params.rounds,
        model.losses[model.best_round - 1] == min(model.losses),
        model.grown == model.best_round + patience == len(model.losses),
        len(model.trees[0].feature) > 1,
    )
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", *[F.lit(bool(f)).alias(n) for f, n in zip(facts, ("stopped", "best_is_lowest", "grew_no_more", "learned"))]
    )


# Features of few values, so that every value is a cut: the hour, the customer's nation, the
# parity of the user.
SPLIT_FEATURES = {"hour": "hour(ts)", "nation": "c_nationkey", "user_digit": "user_id % 10"}


def first_split_sql(grow: str) -> str:
    """Best first split of boosted trees, from sums of gradients and hessians by value."""
    features = " UNION ALL ".join(
        f"SELECT {i} AS i, '{name}' AS feature, ({expr})::DOUBLE AS x, y FROM e" for i, (name, expr) in enumerate(SPLIT_FEATURES.items())
    )
    l2, side = (3.0, "true") if grow == "oblivious" else (0.0, "nl >= 20 AND n - nl >= 20")
    return f"""WITH e AS (SELECT *, (event_type = 'error')::INTEGER AS y FROM events JOIN customer ON user_id = c_custkey),
p AS (SELECT avg(y) AS p FROM e), x AS ({features}),
v AS (SELECT i, feature, x, count(*) AS n, sum(round((p - y) * 1048576)) / 1048576 AS g, count(*) * round(p * (1 - p) * 1048576) / 1048576 AS h
  FROM x, p GROUP BY i, feature, x, p),
c AS (SELECT *, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM v WINDOW w AS (PARTITION BY i ORDER BY x)),
t AS (SELECT i, sum(n) AS n, sum(g) AS g, sum(h) AS h, max(x) AS top FROM v GROUP BY i),
s AS (SELECT c.i, feature, x AS cut, nl, gl * gl / (hl + {l2}) + (t.g - gl) ** 2 / (t.h - hl + {l2}) - t.g ** 2 / (t.h + {l2}) AS gain,
  -0.05 * gl / (hl + {l2}) AS left_value, -0.05 * (t.g - gl) / (t.h - hl + {l2}) AS right_value
  FROM c JOIN t ON c.i = t.i JOIN (SELECT n FROM t LIMIT 1) ON true WHERE x < top AND ({side.replace('n -', 't.n -')}))
SELECT '{grow}' AS grow, feature, cut, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value
FROM s ORDER BY gain DESC, i, cut LIMIT 1"""


def first_split(spark, d, grow: str):
    events, customer = table(spark, d, "events"), table(spark, d, "customer")
    rows = events.join(customer, events["user_id"] == customer["c_custkey"]).select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("y"), *[F.expr(x).cast("double").alias(n) for n, x in SPLIT_FEATURES.items()]
    )
    names = list(SPLIT_FEATURES)
    params = {"grow": grow, "rounds": 1, "leaves": 2, "depth": 1, "l2": 3.0 if grow == "oblivious" else 0.0}
    model = make_learner("boost", "y", 42, params).fit(assemble(rows, names).select("event_id", "y", "features"))
    tree = model.trees[0]
    feature = int(tree.feature[0])
    values = [round(float(v), 6) for v in tree.value[1:3]]
    row = (grow, names[feature], float(model.cuts[feature][tree.cut[0]]), *values)
    return spark.createDataFrame([row], "grow string, feature string, cut double, left_value double, right_value double")


@query("mdl1_leafwise_first_split", first_split_sql("leaf"))
def _(spark, d):
    return first_split(spark, d, "leaf")


@query("mdl2_depthwise_first_split", first_split_sql("depth"))
def _(spark, d):
    return first_split(spark, d, "depth")


@query("mdl3_oblivious_first_split", first_split_sql("oblivious"))
def _(spark, d):
    return first_split(spark, d, "oblivious")


@query("mdl11_member_probabilities")
def _(spark, d):
    """Score every row with the trained ensemble: key, member probabilities, prob, pred."""
    tx = raw_rows(spark, d)
    scorer, _ = trained(tx)
    return scorer.predict(tx)


@query("mdl8_crossfit_calibration")
def _(spark, d):
    rows, columns = engineered(spark, d)
    halves = half_split(rows, ROLES.time, ROLES.key)
    ensemble = Ensemble(PARAMS.members, max_rounds=PARAMS.max_rounds, calibration_mode="crossfit")
    found = ensemble.fit(halves.where("domain = 0"), halves.where("domain = 1"), columns, ROLES.label, ROLES.key)
    return spark.createDataFrame(list(found.items()), "metric string, value double")


@query("met25_saved_model_evaluation")
def _(spark, d):
    """Save, reload, score raw rows in periods, evaluate."""
    tx = raw_rows(spark, d)
    scorer, _ = trained(tx)
    path = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    scorer.save(path, PARAMS)
    again = DriftAwareScorer.load(spark, path)
    return evaluate(again, tx, EvalParams(), periods=PARAMS.periods)


@query("ext2_model_disagreement_by_period")
def _(spark, d):
    tx = raw_rows(spark, d)
    scorer, _ = trained(tx)
    rows = drift_periods(tx, ROLES.time, ROLES.key, PARAMS.periods)
    scored = scorer.predict(rows)
    names = [c for c in scored.columns if c.startswith("prob_")]
    return rounded(
        scored.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.avg(disagreement(names)).alias("disagreement")),
        ["disagreement"],
    )
