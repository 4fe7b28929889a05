import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.splits import half_split
from tidemark.params import EvalParams, Roles, TrainParams
from tidemark.plans.config import params_from_config, read_config
from tidemark.plans.train import DriftAwareScorer, evaluate, train
from tidemark.sources.sinks import read_metrics

MEMBERS = {
    "boost_leafwise": {"type": "boost", "params": {"grow": "leaf", "leaves": 7, "rate": 0.3}, "early_stopping": 2},
    "boost_oblivious": {"type": "boost", "params": {"grow": "oblivious", "depth": 3, "l2": 3.0, "rate": 0.3}},
    "forest": {"type": "rf", "params": {"numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 2}},
}
PARAMS = TrainParams(members=MEMBERS, max_rounds=3, drift_rounds=3, periods=3)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    from tidemark.queries.base import transactions

    df = transactions(spark, "/root/testdata/sf0.001").cache()
    out = str(tmp_path_factory.mktemp("run"))
    scorer, metrics = train(df, Roles(), PARAMS, out=out)
    return df, out, scorer, metrics


def test_training_reports_everything(run):
    _, _, scorer, metrics = run
    got = {(r["scope"], r["metric"]): r["value"] for r in metrics.collect()}
    for name in (
        ("train", "ensemble_auc"),
        ("train", "forest_ap"),
        ("train", "weight_forest"),
        ("train", "adversarial_val_auc"),
        ("train", "training_time_seconds"),
        ("validation", "auroc"),
        ("validation", "calibration_ece"),
        ("validation", "calibration_hl_chi2"),
        ("validation", "contribution_forest_mean"),
        ("validation", "precision_at_recall_80"),
        ("validation", "tpr_at_fpr_0_010"),
        ("periods", "period_2_auc"),
        ("periods", "stability_1_minus_std"),
        ("periods", "drift_detection_recall"),
    ):
        assert name in got, name
    assert sum(v for (_, m), v in got.items() if m.startswith("weight_")) == pytest.approx(1.0)
    assert "TransactionDT" not in scorer.validator.features and "velocity" in scorer.validator.features


def test_saved_metrics_lack_the_time(spark, run):
    _, out, _, metrics = run
    saved = read_metrics(spark, f"{out}/metrics")
    assert saved.count() == metrics.count() - 1
    assert saved.where("metric = 'training_time_seconds'").count() == 0


def test_reload_predicts_the_same(spark, run):
    df, out, scorer, _ = run
    again = DriftAwareScorer.load(spark, out)
    a = scorer.predict(df).select("TransactionID", F.col("prob").alias("x"), "pred")
    b = again.predict(df).select("TransactionID", F.col("prob").alias("y"))
    assert a.join(b, "TransactionID").agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] == 0.0
    assert a.count() == df.count()


def test_drift_of_raw_rows(run):
    df, _, scorer, _ = run
    halves = half_split(df, "TransactionDT", "TransactionID")
    out = scorer.evaluate_drift(*(halves.where(F.col("domain") == i).drop("domain") for i in (1, 0))).first()
    assert 0 <= out["drift_auc"] <= 1 and out["drift_auc"] > 0.5


def test_evaluation_of_a_saved_model(spark, run, tmp_path):
    df, out, _, _ = run
    scorer = DriftAwareScorer.load(spark, out)
    metrics = evaluate(scorer, df, EvalParams(), periods=3, out=f"{tmp_path}/report")
    got = {r["metric"]: r["value"] for r in metrics.collect()}
    assert 0 <= got["auroc"] <= 1 and "drift_detection_f1" in got and "period_0_auc" in got
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/report/summary").collect())
    assert "Calibration" in text and "auroc" in text
    targets = spark.read.json(f"{tmp_path}/report/targets")
    assert targets.count() == 4


def test_empty_frame_raises(run):
    df, _, _, _ = run
    with pytest.raises(ValueError):
        train(df.where("false"), Roles(), PARAMS)


def test_training_is_repeatable(run):
    df, _, _, metrics = run
    _, again = train(df, Roles(), PARAMS)
    a, b = ({r["metric"]: r["value"] for r in m.where("metric = 'ensemble_auc'").collect()} for m in (metrics, again))
    assert a == pytest.approx(b, abs=0.01)


@pytest.mark.parametrize(
    "bad", [{"train_ratio": 1.5}, {"periods": 0}, {"calibration_mode": "x"}, {"parallelism": 0}, {"drift_holdout": 0.0}]
)
def test_parameter_ranges(bad):
    with pytest.raises(ValueError):
        TrainParams(**bad)


def test_eval_parameter_ranges():
    with pytest.raises(ValueError):
        EvalParams(bins=0)
    with pytest.raises(ValueError):
        EvalParams(targets={"x": (0.5, "sideways")})


CONFIG = {
    "training": {"random_seed": 7, "train_ratio": 0.75, "n_drift_periods": 3, "target_column": "isFraud", "early_stopping_rounds": 2},
    "data": {"time_column": "TransactionDT", "id_column": "TransactionID", "use_synthetic": False},
    "evaluation": {"calibration_bins": 5, "drift_threshold": 0.7, "target_metrics": {"auroc": 0.9, "calibration_ece": 0.05}},
    "base_models": {
        "lightgbm": {"model_type": "lightgbm", "params": {"num_leaves": 31, "learning_rate": 0.3, "n_estimators": 3, "feature_fraction": 0.9}},
        "forest": {"type": "rf", "params": {"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 2}},
    },
}


def test_configuration_is_read_and_honoured(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CONFIG, indent=1))
    roles, params, checks = params_from_config(read_config(spark, f"{tmp_path}/c.json"))
    assert (params.seed, params.train_ratio, params.periods, params.drift_threshold) == (7, 0.75, 3, 0.7)
    assert params.members["lightgbm"] == {
        "type": "boost",
        "params": {"grow": "leaf", "leaves": 31, "rate": 0.3, "rounds": 3, "column_share": 0.9},
        "early_stopping": 2,
    }
    assert params.members["forest"]["params"] == {"numTrees": 4, "maxDepth": 3, "minInstancesPerNode": 2}
    assert checks.targets == {"auroc": (0.9, "higher"), "calibration_ece": (0.05, "lower")} and checks.bins == 5
    assert roles.time == "TransactionDT"
    with pytest.raises(ValueError, match="no learner"):
        params_from_config({"base_models": {"x": {"type": "svm"}}})


def test_a_broken_save_leaves_the_published_run(spark, run, tmp_path, monkeypatch):
    from tidemark.operators.drift import DriftValidator

    df, _, scorer, _ = run
    first = scorer.save(f"{tmp_path}/m")
    monkeypatch.setattr(DriftValidator, "save", lambda self, path: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        scorer.save(f"{tmp_path}/m")
    assert json.loads((tmp_path / "m" / "latest.json").read_text())["run_id"] == first
    again = DriftAwareScorer.load(spark, f"{tmp_path}/m")
    assert again.predict(df).count() == df.count()
    monkeypatch.undo()
    second = scorer.save(f"{tmp_path}/m")
    assert json.loads((tmp_path / "m" / "latest.json").read_text())["run_id"] == second != first
    assert not list((tmp_path / "m").glob("*.tmp"))


def test_job_entry_points(spark, run, tmp_path):
    from tidemark.__main__ import main

    df = run[0]
    for name, rows in (("train", df), ("test", df.where("TransactionID % 2 = 0"))):
        rows.write.parquet(f"{tmp_path}/data/{name}_transaction")
    small = {**CONFIG, "base_models": {"forest": CONFIG["base_models"]["forest"]}}
    (tmp_path / "c.json").write_text(json.dumps(small))
    common = ["--data-path", f"{tmp_path}/data", "--format", "parquet", "--config", f"{tmp_path}/c.json"]
    main(["train", *common, "--output-dir", f"{tmp_path}/model", "--quick-test"])
    final = {r["metric"] for r in spark.read.json(f"{tmp_path}/model/results/metrics").collect()}
    assert {"ensemble_auc", "test_auroc", "test_calibration_ece"} <= final
    assert spark.read.json(f"{tmp_path}/model/results/targets").count() == 2
    main(["evaluate", *common, "--model-path", f"{tmp_path}/model", "--output-dir", f"{tmp_path}/eval", "--drift-analysis"])
    assert "drift_detection_f1" in {r["metric"] for r in spark.read.json(f"{tmp_path}/eval/metrics").collect()}


@pytest.mark.parametrize(
    "metric,way",
    [
        ("auroc", "higher"),
        ("log_loss", "lower"),
        ("calibration_brier_score", "lower"),
        ("calibration_mce", "lower"),
        ("total_cost", "lower"),
        ("false_alarm_rate", "lower"),
        ("tpr_at_fpr_0.1", "higher"),
        ("temporal_auc_std", "lower"),
        ("fraud_catch_rate", "higher"),
    ],
)
def test_target_directions(metric, way):
    from tidemark.plans.config import target_from_config

    assert target_from_config(metric, 0.3) == (0.3, way)
    assert target_from_config(metric, {"value": 1, "direction": "lower"}) == (1.0, "lower")


def test_ignored_keys_are_reported(caplog):
    from tidemark.plans.config import params_from_config

    params_from_config({"training": {"val_ratio": 0.1, "test_ratio": 0.1}})
    assert "val_ratio" in caplog.text and "test_ratio" in caplog.text


def test_reported_rows_fit_nothing(transactions):
    from tidemark.params import Roles, TrainParams
    from tidemark.plans.train import prepare

    roles = Roles()
    data = prepare(transactions.withColumn("TransactionAmt", F.when(F.col("card1") % 9 == 0, float("nan")).otherwise(F.col("TransactionAmt"))), roles, TrainParams())
    fitted, reported, rest = data.val.select(roles.key), data.report.select(roles.key), data.train.select(roles.key)
    assert fitted.intersect(reported).isEmpty() and rest.intersect(reported).isEmpty()
    assert fitted.count() + reported.count() + rest.count() == transactions.count() and reported.count() > 50
    assert data.rows.where(F.isnan("TransactionAmt") | F.col("TransactionAmt").isNull()).isEmpty()


def test_a_written_table_is_read_by_many_tasks(spark, monkeypatch):
    from tidemark import session

    monkeypatch.setattr(session, "FILE_ROWS", 100)
    table = session.write_table(spark.range(1000).coalesce(1), "wide")
    assert len(table.inputFiles()) == 10 and table.count() == 1000
