import math

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tidemark.operators.features import (
    FeatureEngineer,
    FeatureModel,
    category_codes,
    encode,
    engineer,
    medians,
    modes,
    unknown_categories,
)
from tidemark.operators.joins import common_columns, left_join_identity, stack_domains
from tidemark.operators.profile import (
    category_frequencies,
    drift_profile,
    histogram,
    numeric_profile,
    rate_by_time_bin,
    schema_profile,
    top_categories,
)
from tidemark.params import Roles

SCHEMA = """TransactionID bigint, TransactionDT double, TransactionAmt double, card1 int, card2 int, ProductCD string,
C1 int, C2 int, V1 double, V2 double, V3 double, isFraud int"""
DATA = [
    (1, 0.0, 10.0, 1, 1, "a", 1, 2, 1.0, 2.0, 3.0, 0),
    (2, 9.0, None, 1, 3, "b", 3, None, 1.0, 1.0, None, 1),
    (3, 90_000.0, 30.0, 2, 0, None, 5, 6, 0.0, 0.0, 0.0, 0),
    (4, 100_000.0, 50.0, 2, 9, "b", 7, 8, None, None, None, 1),
]


@pytest.fixture
def tx(rows):
    return rows(DATA, SCHEMA, 3)


def by_key(df, c):
    return {r["TransactionID"]: r[c] for r in df.select("TransactionID", c).collect()}


def test_engineered_columns(tx):
    out = engineer(tx, Roles(), (30.0, 20.0))
    assert by_key(out, "TransactionAmt_zscore") == {1: -1.0, 2: None, 3: 0.0, 4: 1.0}
    assert by_key(out, "TransactionAmt_log")[1] == pytest.approx(math.log1p(10))
    assert by_key(out, "hour") == {1: 0, 2: 0, 3: 1, 4: 3}
    assert by_key(out, "day_of_week") == {1: 0, 2: 0, 3: 1, 4: 1}
    assert by_key(out, "card1_card2_ratio") == {1: 0.5, 2: 0.25, 3: 2.0, 4: 0.2}
    assert by_key(out, "C_sum") == {1: 3.0, 2: 3.0, 3: 11.0, 4: 15.0}
    assert by_key(out, "C_mean")[2] == 3.0
    assert by_key(out, "V_std") == {1: 1.0, 2: 0.0, 3: 0.0, 4: None}
    assert by_key(out, "velocity") == {1: None, 2: 0.1, 3: None, 4: pytest.approx(1 / 10_001)}
    assert "dist_total" not in out.columns and "D_sum" not in out.columns


def test_batch_zscore_uses_this_table(tx):
    out = by_key(engineer(tx, Roles()), "TransactionAmt_zscore")
    assert out[1] == pytest.approx(-1.0) and out[4] == pytest.approx(1.0)


def test_medians_and_modes(rows):
    df = rows([(1.0, "b"), (2.0, "a"), (None, None), (4.0, "a"), (3.0, "b")], "x double, c string")
    assert medians(df, ["x"]) == {"x": 2.5}
    assert modes(df, ["c"]) == {"c": "a"}


def test_codes_unseen_and_unknown(rows):
    fit = rows([("b",), ("a",), ("b",)], "c string")
    codes = category_codes(fit, ["c"])
    assert {(r["value"], r["code"]) for r in codes.collect()} == {("a", 0), ("b", 1)}
    new = rows([("z",), ("b",), (None,)], "c string")
    assert [r["c"] for r in encode(new, ["c"], codes, {"c": 34}, {}).collect()] == [0, 1, 0]
    assert [r["c"] for r in encode(new, ["c"], codes, {"c": 34}, {"c": 1}).collect()] == [1, 1, 1]
    assert {r["value"] for r in unknown_categories(new, ["c"], codes).collect()} == {"z", "nan"}


def test_large_code_tables_are_not_broadcast(rows):
    codes = category_codes(rows([("a",), ("b",)], "c string"), ["c"])
    df = rows([("b",)], "c string")

    def hinted(size):
        plan = encode(df, ["c"], codes, {"c": size}, {})._jdf.queryExecution().optimizedPlan().toString()
        (join,) = [line for line in plan.split("\n") if "Join LeftOuter" in line]
        return "strategy=broadcast" in join

    assert hinted(2) and not hinted(10**7)


def test_fit_transform_is_complete_and_scaled(transactions):
    model = FeatureEngineer().fit(transactions)
    out = model.transform(transactions)
    stats = out.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(model.feature_columns)],
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(model.feature_columns)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(model.feature_columns)],
    ).first()
    assert out.count() == transactions.count()
    for i, c in enumerate(model.feature_columns):
        assert stats[f"n_{i}"] == 0, c
        if c != "velocity":  # first rows are filled, which moves its mean
            assert stats[f"m_{i}"] == pytest.approx(0, abs=1e-9), c
            assert stats[f"s_{i}"] == pytest.approx(1, abs=1e-9), c


def test_null_rows_are_imputed(rows):
    data = [(i, float(i * 1000), None if i < 11 else float(i), i % 7, i % 3, None if 5 <= i < 16 else "ab"[i % 2], 1, 2, 1.0, 2.0, 3.0, i % 2) for i in range(60)]
    df = rows(data, SCHEMA, 4)
    model = FeatureEngineer(null_fill=None).fit(df)
    out = model.transform(df)
    nulls = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in model.feature_columns]).first().asDict()
    assert {c for c, n in nulls.items() if n} == {"velocity"}
    assert model.state["medians"]["TransactionAmt"] == 35.0
    assert model.state["modes"]["ProductCD"] == "a"


def test_model_in_pipeline_save_and_load(spark, transactions, tmp_path):
    model = Pipeline(stages=[FeatureEngineer(unseen="mode")]).fit(transactions).stages[0]
    model.save(f"{tmp_path}/features")
    again = FeatureModel.load(f"{tmp_path}/features")
    a = model.transform(transactions).orderBy("TransactionID").toPandas()
    b = again.transform(transactions).orderBy("TransactionID").toPandas()
    assert a.equals(b)
    assert again.roles == model.roles


def test_carried_columns_pass_through(transactions):
    df = transactions.withColumn("period", F.col("TransactionID") % 3).withColumn("split", F.lit("train"))
    model = FeatureEngineer(keep_profile=False).fit(df)
    assert not {"period", "split"} & set(model.feature_columns)
    assert model.transform(df).where("split <> 'train' or period <> TransactionID % 3").count() == 0


def test_profiles(rows):
    df = rows([(float(i), "ab"[i % 2], i) for i in [1, 2, 3, 10]], "x double, c string, isFraud int")
    p = numeric_profile(df, ["x"]).first()
    assert (p["mean"], p["min"], p["max"], p["q25"], p["q75"]) == (4.0, 1.0, 10.0, 1.75, 4.75)
    assert numeric_profile(df, ["x"], approx=True).first()["q25"] in (1.0, 2.0)
    x = df.toPandas().x
    assert drift_profile(df, ["x"]).first()["skew"] == pytest.approx(x.skew())
    assert drift_profile(df.limit(2), ["x"]).first()["skew"] is None
    assert sorted(r["frequency"] for r in category_frequencies(df, ["c"]).collect()) == [0.5, 0.5]
    assert top_categories(df, ["c"], 1).first()["value"] == "a"
    kinds = {r["column"]: r["kind"] for r in schema_profile(df, Roles()).collect()}
    assert kinds == {"x": "numeric", "c": "categorical"}


def test_empty_time_bins_appear(rows):
    df = rows([(0.0, 1), (100.0, 0)], "t double, y int")
    got = {r["bin"]: (r["n"], r["fraud_rate"]) for r in rate_by_time_bin(df, "t", "y", 4).collect()}
    assert got == {0: (1, 1.0), 1: (0, None), 2: (0, None), 3: (1, 0.0)}


def test_histogram_of_a_constant_column(rows):
    got = histogram(rows([(7.0,)] * 3, "x double"), "x", 10).collect()
    assert [(r["bin"], r["n"], r["bin_low"]) for r in got] == [(5, 3, 7.0)]
    assert got[0]["density"] == pytest.approx(10.0)


def test_left_join_suffixes_and_duplicates(rows):
    a = rows([(1, "x", 5), (2, "y", 6)], "id int, name string, v int")
    b = rows([(1, "p", 7), (1, "q", 8)], "id int, name string, w int")
    out = left_join_identity(a, b, "id")
    assert out.columns == ["id", "name_x", "v", "name_y", "w"]
    assert sorted((r["id"], r["w"] or 0) for r in out.collect()) == [(1, 7), (1, 8), (2, 0)]


def test_stack_domains(rows):
    a = rows([(1, 1.0, 0)] * 100, "TransactionID int, f double, isFraud int")
    b = rows([(2.0, 9, 1)] * 80, "f double, extra int, isFraud int")
    out = stack_domains(a, b, Roles().reserved())
    assert out.columns == ["f", "domain"]
    assert {r["domain"]: r["count"] for r in out.groupBy("domain").count().collect()} == {0: 100, 1: 80}
    assert common_columns(a, b) == ["f", "isFraud"]
    with pytest.raises(ValueError):
        stack_domains(b, a, ("isFraud", "TransactionID"))


def test_saved_pipeline_scores_the_same(spark, transactions, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    features = ["TransactionAmt", "TransactionAmt_log", "ProductCD", "velocity", "hour"]
    stages = [
        FeatureEngineer(unseen="mode", null_fill=1.0),
        VectorAssembler(inputCols=features, outputCol="features"),
        LogisticRegression(labelCol="isFraud", maxIter=5),
    ]
    pipeline = Pipeline(stages=stages)
    pipeline.write().overwrite().save(f"{tmp_path}/plan")
    model = Pipeline.load(f"{tmp_path}/plan").fit(transactions)
    assert model.stages[0].options["unseen"] == "mode" and model.stages[0].options["null_fill"] == 1.0
    model.write().overwrite().save(f"{tmp_path}/fitted")
    again = PipelineModel.load(f"{tmp_path}/fitted")
    assert [s.uid for s in again.stages] == [s.uid for s in model.stages]
    first, second = (
        {r["TransactionID"]: r["probability"][1] for r in m.transform(transactions).select("TransactionID", "probability").collect()}
        for m in (model, again)
    )
    assert first == second and len(set(first.values())) > 10
    assert again.stages[0].profile is not None
