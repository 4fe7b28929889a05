"""Learned queries fit with the default rounds: nothing is cut but by patience."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.boosting import HistogramBooster
from tidemark.params import TrainParams
from tidemark.queries import drift_models

ROWS = 500


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    late = F.col("id") > ROWS / 2
    spark.range(ROWS).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"),
        (F.col("id") * 7 % 40).alias("user_id"),
        F.when(F.col("id") * 13 % 10 < F.when(late, 4).otherwise(2), "error").otherwise("view").alias("event_type"),
        (F.col("id") * 37 % 101 + F.when(late, 20).otherwise(0)).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") * 3 % 17, F.lit("}")).alias("props"),
    ).write.parquet(f"{d}/events.parquet")
    spark.range(40).select(
        F.col("id").alias("c_custkey"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.element_at(F.array(F.lit("AUTO"), F.lit("HOME")), (F.col("id") % 2 + 1).cast("int")).alias("c_mktsegment"),
        (F.col("id") * 11.5).alias("c_acctbal"),
    ).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.fixture
def fits(monkeypatch):
    """(settings, patience, model) of every boosted fit."""
    found, own = [], HistogramBooster.fit

    def fit(self, train, held=None, patience=None, ready=None):
        model = own(self, train, held, patience, ready)
        found.append((self.params, patience, model))
        return model

    monkeypatch.setattr(HistogramBooster, "fit", fit)
    return found


def members_grew_whole(fits):
    most = TrainParams().max_rounds
    assert [p.grow for p, *_ in fits] == ["leaf", "depth", "oblivious"] and {p.rounds for p, *_ in fits} == {most}
    assert all(m.grown in (m.best_round + patience, most) for _, patience, m in fits)


def test_drift_is_predicted_after_all_rounds(spark, tables, fits):
    row = entry.queries()["drf2_predict_drift"](spark, tables).first()
    assert [(p.rounds, m.grown) for p, _, m in fits] == [(100, 100)] and 0.5 < row["drift_auc"] <= 1.0


class _Asked(Exception):
    pass


@pytest.mark.parametrize(
    "name", ["drf6_raw_drift_evaluation", "ext2_model_disagreement_by_period", "mdl11_member_probabilities"]
)
def test_training_is_asked_for_whole(spark, tables, monkeypatch, name):
    def asked(df, roles, params, *args, **kw):
        assert params == TrainParams() and (params.max_rounds, params.drift_rounds) == (1000, 100)
        assert df.count() == ROWS
        raise _Asked

    monkeypatch.setattr(drift_models, "train", asked)
    with pytest.raises(_Asked):
        entry.queries()[name](spark, tables)


def test_training_grows_members_and_validators_whole(spark, tables, fits):
    got = {r["metric"] for r in entry.queries()["mdl13_end_to_end_training"](spark, tables).collect()}
    assert {"ensemble_auc", "adversarial_val_auc", "auroc", "drift_detection_recall"} <= got
    members_grew_whole(fits[:3])
    assert [(p.rounds, m.grown) for p, _, m in fits[3:]] == [(100, 100)] * 2


def test_crossfit_members_grow_whole(spark, tables, fits):
    got = {r["metric"] for r in entry.queries()["mdl8_crossfit_calibration"](spark, tables).collect()}
    assert {"boost_leafwise_auc", "ensemble_ap"} <= got
    members_grew_whole(fits[:3])
    kept = [m.best_round for _, _, m in fits[:3] for _ in range(3)]
    assert [m.grown for *_, m in fits[3:]] == kept
