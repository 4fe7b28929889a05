import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.ensemble import Ensemble, apply_isotonic, auc_weights, calibration_points, disagreement, fit_isotonic

MEMBERS = {
    "boost": {"type": "boost", "params": {"grow": "depth", "depth": 3, "rounds": 8, "rate": 0.3}, "early_stopping": 2},
    "forest": {"type": "rf", "params": {"numTrees": 5, "maxDepth": 4}},
}


def labelled(rows, n=1_200, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(2 - 2 * x[:, 0]))).astype(int)
    data = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return rows(data, "TransactionID bigint, a double, b double, isFraud int", 4)


@pytest.fixture(scope="module")
def fitted(spark):
    def make(data, schema, partitions):
        return spark.createDataFrame(data, schema).repartition(partitions)

    df = labelled(make).cache()
    model = Ensemble(MEMBERS)
    metrics = model.fit(df.where("TransactionID < 800"), df.where("TransactionID >= 800"), ["a", "b"], "isFraud", "TransactionID")
    return df, model, metrics


def test_metrics_weights_and_probabilities(fitted):
    df, model, metrics = fitted
    assert set(metrics) == {"boost_auc", "boost_ap", "forest_auc", "forest_ap", "ensemble_auc", "ensemble_ap"}
    assert all(0 <= v <= 1 for v in metrics.values()) and metrics["ensemble_auc"] > 0.7
    assert sum(model.weights.values()) == pytest.approx(1.0)
    assert model.weights["boost"] / model.weights["forest"] == pytest.approx(metrics["boost_auc"] / metrics["forest_auc"])
    out = model.predict(df)
    bad = out.where((F.col("prob") < 0) | (F.col("prob") > 1) | (F.col("pred") != (F.col("prob") > 0.5).cast("int")))
    assert bad.count() == 0 and out.count() == df.count()
    mean = model.weights["boost"] * F.col("prob_boost") + model.weights["forest"] * F.col("prob_forest")
    assert out.agg(F.max(F.abs(F.col("prob") - mean))).first()[0] < 1e-12
    assert model.contributions(df).count() == 2 * df.count()


def test_save_and_load(spark, fitted, tmp_path):
    df, model, _ = fitted
    model.save(f"{tmp_path}/e")
    again = Ensemble.load(spark, f"{tmp_path}/e")
    a, b = (m.predict(df).select("TransactionID", F.col("prob").alias(n)) for m, n in ((model, "x"), (again, "y")))
    assert a.join(b, "TransactionID").agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] == 0.0
    assert again.weights == model.weights


def test_crossfit_and_uncalibrated(spark, fitted, tmp_path):
    df, plain, _ = fitted
    halves = df.where("TransactionID < 800"), df.where("TransactionID >= 800")
    cross = Ensemble({"forest": MEMBERS["forest"]}, calibration_mode="crossfit")
    cross.fit(*halves, ["a", "b"], "isFraud", "TransactionID")
    assert len(cross.calibrators["forest"]) == 3
    cross.save(f"{tmp_path}/c")
    again = Ensemble.load(spark, f"{tmp_path}/c")
    first = cross.predict(df).agg(F.sum("prob")).first()[0]
    assert again.predict(df).agg(F.sum("prob")).first()[0] == pytest.approx(first, rel=1e-12)
    raw = Ensemble({"forest": MEMBERS["forest"]}, calibrate=False)
    raw.fit(*halves, ["a", "b"], "isFraud", "TransactionID")
    assert raw.calibrators == {}


def test_crossfit_of_boosted_members_takes_the_rounds_that_were_kept(fitted):
    df, _, _ = fitted
    halves = df.where("TransactionID < 800"), df.where("TransactionID >= 800")
    cross = Ensemble({"boost": MEMBERS["boost"]}, calibration_mode="crossfit")
    cross.fit(*halves, ["a", "b"], "isFraud", "TransactionID")
    kept = cross.models["boost"].best_round
    assert [clone.grown for clone, _ in cross.calibrators["boost"]] == [kept] * 3


def test_bad_members(fitted):
    df, _, _ = fitted
    with pytest.raises(ValueError, match="no learner"):
        Ensemble({"x": {"type": "svm"}})
    broken = {**MEMBERS, "broken": {"type": "rf", "params": {"maxDepth": 31}}}
    model = Ensemble(broken, calibrate=False)
    model.fit(df.where("TransactionID < 800"), df.where("TransactionID >= 800"), ["a", "b"], "isFraud", "TransactionID")
    assert set(model.models) == {"boost", "forest"} and "broken" in model.failures
    with pytest.raises(ValueError, match="fit it first"):
        Ensemble({}).predict(df)


def test_reweighting_prefers_steady_members(spark, fitted, tmp_path):
    df, model, _ = fitted
    model.save(f"{tmp_path}/w")
    again = Ensemble.load(spark, f"{tmp_path}/w")
    weights = again.reweight(df.withColumn("period", (F.col("TransactionID") / 300).cast("int")))
    assert set(weights) == set(MEMBERS) and sum(weights.values()) == pytest.approx(1.0)
    assert again.weights == weights != model.weights


def test_no_validator_says_so(fitted):
    df, model, _ = fitted
    row = model.detect_drift(df).first()
    assert row["is_drift_detected"] is False and row["message"] == "no drift validator was fitted"


def brute_isotonic(x, y):
    xs = np.unique(x)
    ys = np.array([y[x == v].mean() for v in xs])
    w = np.array([(x == v).sum() for v in xs], dtype=float)
    blocks = []
    for value, weight in zip(ys, w):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, ww, c = blocks.pop()
            u, uw, d = blocks.pop()
            blocks.append([(u * uw + v * ww) / (uw + ww), uw + ww, c + d])
    return xs, np.concatenate([[v] * c for v, _, c in blocks])


def test_isotonic_matches_pooling(rows):
    rng = np.random.default_rng(1)
    x = np.round(rng.uniform(size=900), 2)
    y = (rng.uniform(size=900) < x**2).astype(int)
    df = rows([(float(a), int(b)) for a, b in zip(x, y)], "prob double, label int", 5)
    xs, fit = brute_isotonic(x, y)
    out = apply_isotonic(rows([(float(v),) for v in xs], "prob double"), fit_isotonic(df, "label", "prob"), "prob", "q")
    np.testing.assert_allclose([r["q"] for r in out.orderBy("prob").collect()], fit)


def test_pooled_calibration_keeps_every_row(rows):
    x = [i / 5_000 for i in range(5_000)]
    df = rows([(v, int(v > 0.5)) for v in x], "prob double, label int", 5)
    points = calibration_points(df, "label", "prob", bins=100)
    got = points.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label")), F.count(F.lit(1))).first()
    assert got[0] == 5_000 and got[1] == pytest.approx(2_499) and got[2] <= 110
    assert calibration_points(df, "label", "prob").count() == 5_000


def test_weights_and_disagreement(rows):
    assert auc_weights({"a": 0.6, "b": 0.9}) == {"a": pytest.approx(0.4), "b": pytest.approx(0.6)}
    assert auc_weights({"a": 0.5, "b": 0.5}, {"a": 0.5, "b": 1.0})["b"] == pytest.approx(2 / 3)
    df = rows([(0.0, 1.0), (0.3, 0.3)], "a double, b double")
    assert [r[0] for r in df.select(disagreement(["a", "b"])).collect()] == [0.5, 0.0]


def test_members_are_binned_once_and_validation_rows_scored_once(spark, monkeypatch):
    from tidemark.operators import ensemble as en
    from tidemark.operators.boosting import HistogramBooster

    df = spark.range(600).selectExpr("id AS k", "double(id % 7) AS a", "double(id % 11) AS b", "int(id % 7 > 3) AS y")
    config = {"type": "boost", "params": {"grow": "depth", "depth": 2, "rounds": 3}, "early_stopping": 2}
    binned, scored = [], []
    own, probability = HistogramBooster.binned, en.with_probability
    monkeypatch.setattr(HistogramBooster, "binned", lambda self, *args, **kw: binned.append(1) or own(self, *args, **kw))
    monkeypatch.setattr(en, "with_probability", lambda *args: scored.append(args[2]) or probability(*args))
    model = Ensemble({"one": config, "two": config})
    found = model.fit(df.where("k < 400"), df.where("k >= 400"), ["a", "b"], "y", "k")
    assert not model.failures and len(binned) == 1 and sorted(scored) == ["prob_one", "prob_two"]
    assert found["ensemble_auc"] == 1.0 and set(model.calibrators) == {"one", "two"}
