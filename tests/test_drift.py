import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.drift import DriftValidator, detection_metrics, sweep_thresholds
from tidemark.operators.learners import best_round, fit_boosted, make_learner, assemble

SMALL = {"grow": "leaf", "leaves": 8, "rounds": 5, "rate": 0.3}


def domains(rows, shift, n=800):
    rng = np.random.default_rng(12)
    data = [
        (i, float(rng.normal() + (shift if i % 2 else 0)), float(rng.normal()), i % 2) for i in range(n)
    ]
    return rows(data, "TransactionID bigint, a double, b double, domain int", 4)


def test_same_distribution_is_near_half_and_shift_is_found(rows):
    same = DriftValidator(params=SMALL).fit(domains(rows, 0.0), ["a", "b"], "TransactionID")
    assert abs(same["val_auc"] - 0.5) < 0.15
    far = domains(rows, 6.0)
    validator = DriftValidator(params=SMALL)
    found = validator.fit(far, ["a", "b"], "TransactionID")
    assert found["val_auc"] > 0.98 and found["drift_auc"] == found["val_auc"]
    out = validator.predict_drift(far).first()
    assert out["is_drift_detected"] and out["score_difference"] > 0.4
    assert out["score_difference"] == pytest.approx(out["drift_mean_score"] - out["reference_mean_score"])
    top = validator.top_features(far.sparkSession, 1).collect()
    assert [r["feature"] for r in top] == ["a"]


def test_unfitted_and_unknown_learner(spark, rows):
    validator = DriftValidator()
    with pytest.raises(ValueError, match="not fitted"):
        validator.predict_drift(domains(rows, 0.0))
    assert validator.top_features(spark, 5).count() == 0
    with pytest.raises(ValueError, match="no learner"):
        DriftValidator("svm").fit(domains(rows, 0.0), ["a"], "TransactionID")


@pytest.mark.parametrize("kind", ["rf", "logreg", "gbt", "boost"])
def test_other_learners_and_reload(spark, rows, tmp_path, kind):
    df = domains(rows, 3.0)
    params = {"rf": {"numTrees": 5, "maxDepth": 3}, "boost": {"rounds": 5}}.get(kind, {"maxIter": 5})
    validator = DriftValidator(kind, params=params)
    assert validator.fit(df, ["a", "b"], "TransactionID")["val_auc"] > 0.9
    validator.save(f"{tmp_path}/v")
    again = DriftValidator.load(spark, f"{tmp_path}/v")
    diff = validator.score(df, "x").join(again.score(df, "y"), "TransactionID").agg(F.max(F.abs(F.col("x") - F.col("y"))))
    assert diff.first()[0] == 0.0


def test_one_domain_is_an_error(rows):
    with pytest.raises(Exception):
        DriftValidator(params=SMALL).fit(domains(rows, 0.0).where("domain = 0"), ["a"], "TransactionID")


def brute_detection(scores):
    y = np.array([1 if i >= len(scores) // 2 else 0 for i in range(len(scores))])
    s = np.array(scores)
    if len(set(y)) < 2:
        return (0.0,) * 3
    best, thr = 0.0, 0.6

    def rates(t):
        tp, fp, fn = ((s > t) & (y == 1)).sum(), ((s > t) & (y == 0)).sum(), ((s <= t) & (y == 1)).sum()
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn)
        return r, p, (2 * p * r / (p + r) if p + r else 0.0)

    for t in np.linspace(0.3, 0.9, 100):
        if rates(t)[2] > best:
            best, thr = rates(t)[2], t
    return rates(thr)


@pytest.mark.parametrize(
    "scores",
    [[0.5, 0.55, 0.7, 0.8], [0.9, 0.8, 0.4, 0.35], [0.1, 0.1, 0.2, 0.2], [0.4, 0.6, 0.6, 0.65, 0.5], [0.7], [0.95] * 6],
)
def test_detection_matches_the_sweep(rows, scores):
    df = rows([(i + 1, float(s)) for i, s in enumerate(scores)], "period int, drift_score double")
    got = detection_metrics(df).first()
    r, p, f1 = brute_detection(scores)
    assert got["drift_detection_recall"] == pytest.approx(r)
    assert got["drift_detection_precision"] == pytest.approx(p)
    assert got["drift_detection_f1"] == pytest.approx(f1)


def test_no_candidates_give_zeros(rows):
    got = detection_metrics(rows([], "period int, drift_score double")).first()
    assert got["drift_detection_recall"] == 0.0 and got["drift_detection_auc"] == 0.0


def test_sweep_grid():
    grid = sweep_thresholds()
    assert len(grid) == 100 and np.allclose(grid, np.linspace(0.3, 0.9, 100), atol=1e-15)


def test_best_round():
    assert best_round([3, 2, 1, 1.5, 1.2], 2) == (3, True)
    assert best_round([3, 2, 1, 1.5, 1.2], 3) == (3, False)
    assert best_round([3, 2, 2.5, 1], 3) == (4, False)


def test_early_stopping_equals_a_shorter_fit(rows):
    df = assemble(domains(rows, 0.7), ["a", "b"])
    train, val = df.where("TransactionID % 3 > 0"), df.where("TransactionID % 3 = 0")
    learner = make_learner("gbt", "domain", 3, {"maxDepth": 4, "maxIter": 12, "stepSize": 0.5})
    model, best = fit_boosted(learner, train, val, patience=2, first_rounds=4)
    full = learner.fit(train)
    losses = full.evaluateEachIteration(val)
    assert best == best_round(losses, 2)[0]
    assert model.evaluateEachIteration(val) == pytest.approx(losses[:best])


def test_rows_are_scored_once_before_they_are_ranked(rows, monkeypatch):
    """Ranks take several passes: over written scores, not over the model."""
    from tidemark.operators import drift

    read = []
    plain = drift.ranking_metrics
    monkeypatch.setattr(drift, "ranking_metrics", lambda df, *a: read.append(df.inputFiles()) or plain(df, *a))
    data = rows([(i, float(i % 7), float(i % 3), int(i % 2)) for i in range(200)], "k long, a double, b double, domain int", 2)
    validator = drift.DriftValidator("boost", params={"rounds": 1})
    validator.fit(data, ["a", "b"], "k")
    validator.predict_drift(data).collect()
    assert len(read) == 2 and all(files and all("drift-scores" in f for f in files) for files in read)


def test_rows_are_assembled_once_for_all_passes_of_a_learner(spark, rows):
    """A learner's passes, the scores and other learners read kept rows, not the domains anew."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    plain = domains(rows, 1.0)
    data = plain.withColumn("a", counted("a"))
    kinds = {"rf": {"numTrees": 3, "maxDepth": 3}, "gbt": {"maxIter": 2}, "logreg": {"maxIter": 3}, "boost": {"rounds": 2}}
    kept, alone = spark.sparkContext._jsc.getPersistentRDDs().size(), {}
    for kind in ("rf", "gbt", "logreg"):
        before = read.value
        alone[kind] = DriftValidator(kind, params=kinds[kind]).fit(data, ["a", "b"], "TransactionID")
        assert read.value - before == 800
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept

    before = read.value
    ready = DriftValidator().rows(data, ["a", "b"], "TransactionID").persist()
    shared = {k: DriftValidator(k, params=p).fit(data, ["a", "b"], "TransactionID", ready=ready) for k, p in kinds.items()}
    assert read.value - before == 800 and ready.is_cached
    ready.unpersist()
    assert {k: shared[k] for k in alone} == alone
    assert shared["boost"] == DriftValidator("boost", params=kinds["boost"]).fit(plain, ["a", "b"], "TransactionID")
