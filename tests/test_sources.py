import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.params import Roles
from tidemark.sources.readers import load_data, read_optional, read_table, read_transactions, with_time_parts
from tidemark.sources.sinks import (
    check_targets,
    dict_to_metrics,
    read_json,
    read_metrics,
    report_lines,
    wide_to_metrics,
    write_json,
    write_metrics,
    write_report,
    write_scores,
)
from tidemark.streaming.monitor import monitor, period_flags, read_scored_stream, retrain_threshold, run_available

TX = "TransactionID,TransactionDT,TransactionAmt,isFraud\n1,0,10.5,0\n2,90000,NaN,1\n3,180000,7,0\n"
ID = "TransactionID,DeviceType\n1,mobile\n1,desktop\n3,mobile\n"


@pytest.fixture
def csv_dir(tmp_path):
    for name in ("train", "test"):
        (tmp_path / f"{name}_transaction.csv").write_text(TX)
    (tmp_path / "train_identity.csv").write_text(ID)
    return str(tmp_path)


def test_transactions_with_and_without_identity(spark, csv_dir):
    train, test = load_data(spark, csv_dir)
    assert train.count() == 4 and "DeviceType" in train.columns
    assert test.count() == 3 and "DeviceType" not in test.columns
    got = {r["TransactionID"]: r for r in test.collect()}
    assert got[2]["TransactionAmt"] is None
    assert (got[2]["hour"], got[2]["day_of_week"], got[2]["time_period"]) == (1, 1, 4)
    assert (got[1]["time_period"], got[3]["time_period"]) == (0, 9)


def test_schema_instead_of_inference(spark, csv_dir):
    schema = "TransactionID bigint, TransactionDT double, TransactionAmt double, isFraud int"
    df = read_transactions(spark, csv_dir, "test", schemas={"transaction": schema})
    assert df.schema["TransactionDT"].dataType.simpleString() == "double" and df.count() == 3


def test_missing_tables(spark, tmp_path):
    assert read_optional(spark, f"{tmp_path}/nothing") is None
    with pytest.raises(AnalysisException):
        read_transactions(spark, f"{tmp_path}/nothing", "train")


def test_own_hour_is_kept(rows):
    df = rows([(0.0, 17)], "TransactionDT double, hour int")
    assert with_time_parts(df).first()["hour"] == 17


def test_filters_reach_the_parquet_scan(spark, sf_small):
    df = read_table(spark, f"{sf_small}/events.parquet").where("value > 400").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,400.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_metric_table_round_trip(spark, rows, tmp_path):
    per = rows([(0, 0.5), (1, 0.7)], "period int, auc double")
    metrics = wide_to_metrics(per, "test", "period", "period_").unionByName(dict_to_metrics(spark, {"a": 1.0, "b": None}, "test"))
    for run in ("r1", "r2"):
        write_metrics(metrics, f"{tmp_path}/m", run)
    assert read_metrics(spark, f"{tmp_path}/m").count() == 6
    got = {r["metric"]: r["value"] for r in read_metrics(spark, f"{tmp_path}/m", "r2").collect()}
    assert got == {"period_0_auc": 0.5, "period_1_auc": 0.7, "a": 1.0}


def test_targets_know_their_direction(spark):
    metrics = dict_to_metrics(spark, {"calibration_ece": 0.02, "auroc": 0.93}, "test")
    got = {r["metric"]: r["met"] for r in check_targets(metrics, {"calibration_ece": (0.03, "lower"), "auroc": (0.94, "higher"), "missing": (0.1, "lower")}).collect()}
    assert got == {"calibration_ece": True, "auroc": False, "missing": False}


def test_report_places_each_metric_once(spark, tmp_path):
    values = {"auroc": 0.9, "precision": 0.5, "precision_at_recall_50": 0.4, "calibration_ece": 0.1, "period_0_auc": 0.8, "odd": 1.0}
    lines = report_lines(list(values.items()), "T")
    for name in values:
        assert sum(line.strip().startswith(f"{name}:") for line in lines) == 1
    text = write_report(dict_to_metrics(spark, values, "test"), f"{tmp_path}/r")
    assert text.index("Calibration") < text.index("Business")
    assert spark.read.json(f"{tmp_path}/r/metrics").count() == len(values)


def test_json_and_scores(spark, rows, tmp_path):
    write_json(spark, {"a": [1, 2]}, f"{tmp_path}/j")
    assert read_json(spark, f"{tmp_path}/j") == {"a": [1, 2]}
    scored = rows([(1, 0.2, 0, 0), (2, 0.8, 1, 1)], "TransactionID bigint, prob double, pred int, period int")
    write_scores(scored, f"{tmp_path}/s", "TransactionID", "period")
    assert spark.read.parquet(f"{tmp_path}/s").where("period = 1").first()["pred"] == 1


def test_stream_equals_table_for_closed_windows(spark, tmp_path):
    rows = spark.range(1000).select(
        F.timestamp_seconds(F.col("id") * 600).alias("ts"),
        (F.col("id") % 10 / 10).alias("prob"),
        (F.col("id") % 10 / 10).alias("m1"),
        F.lit(0.5).alias("m2"),
    )
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = read_scored_stream(spark, f"{tmp_path}/in", rows.schema)
    args = dict(members=["m1", "m2"], row_threshold=0.2, uncertain_limit=0.3)
    out = run_available(monitor(stream, "ts", **args), f"{tmp_path}/out", f"{tmp_path}/cp")
    table = monitor(rows, "ts", **args)
    a = [tuple(r) for r in out.orderBy("window_start").collect()]
    b = [tuple(r) for r in table.orderBy("window_start").collect()]
    assert len(b) == 7 and len(a) == 6
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[-1] == y[-1] and x[3:-1] == pytest.approx(y[3:-1])


def test_retraining_trigger(rows):
    df = rows([(p, 0.5, 0.5, 0.5 + p * i / 100) for p in (0, 1) for i in range(50)], "period int, prob double, m1 double, m2 double")
    threshold = retrain_threshold(df.where("period = 0"), ["m1", "m2"], 0.95)
    assert threshold == 0.0
    got = {r["period"]: r["retrain"] for r in period_flags(df, "period", ["m1", "m2"], threshold).collect()}
    assert got == {0: False, 1: True}


def test_checkpoint_folder_comes_from_the_session(spark):
    from tidemark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert spark.sparkContext.getCheckpointDir().startswith(("file:" + shared, shared))
    assert Roles().reserved()[:2] == ("isFraud", "TransactionID")
