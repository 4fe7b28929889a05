import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from tidemark.operators.ranking import ranking_metrics
from tidemark.operators.score_state import add_batch, compact, state_confusion, state_metrics, state_points
from tidemark.operators.stability import period_metrics
from tidemark.session import scratch_path
from tidemark.streaming.velocity import keep_scores, live_time_since_previous


@pytest.fixture
def folder(spark):
    return scratch_path(spark, f"live-test-{uuid.uuid4().hex}")


@pytest.fixture
def scored(rows):
    rng = np.random.default_rng(3)
    n = 900
    data = zip(rng.integers(0, 4, n).tolist(), rng.integers(0, 2, n).tolist(), (rng.integers(0, 40, n) / 40).tolist())
    return rows([*data, (1, None, 0.5), (1, 1, None), (None, 1, 0.2), (None, 0, 0.1)], "period int, label int, prob double", 4)


def table_of(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_batches_in_any_cut_equal_the_full_metrics(spark, scored, folder):
    for batch in range(3):
        add_batch(scored.where(F.abs(F.hash("prob")) % 3 == batch), folder, batch)
    add_batch(scored.where(F.abs(F.hash("prob")) % 3 == 1), folder, 1)  # a replay
    got = state_metrics(state_points(spark, folder, IntegerType()))
    rest = scored.where(F.col("prob").isNull())  # hash of NULL lands in one batch; it counts nowhere
    assert rest.count() == 1
    assert table_of(got) == table_of(period_metrics(scored))


def test_folded_batches_and_some_periods(spark, scored, folder):
    for batch in range(4):
        add_batch(scored.where(F.col("period") == batch), folder, batch)
    compact(spark, folder, folder + "-folded", IntegerType(), 2)
    points = state_points(spark, folder + "-folded", IntegerType(), periods=[1, 3])
    assert table_of(state_metrics(points)) == table_of(period_metrics(scored.where("period IN (1, 3)")))
    batches = spark.read.parquet(folder + "-folded").select("batch").distinct()
    assert sorted(r[0] for r in batches.collect()) == [2, 3]
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [period" in plan.replace("PartitionFilters: [isnotnull(period#", "PartitionFilters: [period")


def test_names_as_periods_and_an_empty_batch(spark, scored, folder):
    named = scored.withColumn("period", F.concat(F.lit("a/b="), F.col("period").cast("string")))
    add_batch(named, folder, 0)
    add_batch(named.limit(0), folder, 1)
    got = state_metrics(state_points(spark, folder, StringType()))
    assert table_of(got) == table_of(period_metrics(named))


def test_confusion_from_the_state(spark, scored, folder):
    add_batch(scored, folder, 0)
    got = state_confusion(state_points(spark, folder, IntegerType()), [0.3, 0.6])
    pdf = scored.where("label IS NOT NULL AND prob IS NOT NULL AND period IS NOT NULL").toPandas()
    for r in got.where("period IS NOT NULL").collect():
        own = pdf[pdf.period == r["period"]]
        flagged = own.prob > r["threshold"]
        assert r["tp"] == int((flagged & (own.label == 1)).sum()) and r["fn"] == int((~flagged & (own.label == 1)).sum())
        assert r["fp"] == int((flagged & (own.label == 0)).sum()) and r["tn"] == int((~flagged & (own.label == 0)).sum())


def test_a_stream_of_scores_equals_the_table(spark, scored, folder):
    for part in range(3):
        scored.where(F.abs(F.hash("prob", "label")) % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keep_scores(stream, f"{folder}/state", f"{folder}/progress")
    points = state_points(spark, f"{folder}/state", IntegerType())
    assert table_of(state_metrics(points)) == table_of(period_metrics(scored))
    assert spark.read.parquet(f"{folder}/state").select("batch").distinct().count() == 3


def test_live_gaps_equal_the_table_over_late_rows(spark, folder):
    """Files whose rows overlap in time by less than the delay, with ties, NULL cards and a hot card."""
    rng = np.random.default_rng(8)
    n = 1_500
    at = np.sort(rng.integers(0, 5_000, n)) * 1_000_000
    card = [None if c == 9 else int(c) for c in np.where(rng.uniform(size=n) < 0.4, 1, rng.integers(0, 10, n))]
    keys = (rng.permutation(n) + 9007199254740993).tolist()
    pdf = pd.DataFrame({"k": keys, "card": pd.array(card, "Int64"), "t": at})
    late = (at + rng.integers(0, 500, n) * 1_000_000) // 1_250_000_000  # up to 500 s late
    for part in sorted(set(late.tolist())):
        own = [(int(k), None if c is pd.NA else int(c), int(t)) for k, c, t in pdf[late == part].itertuples(index=False)]
        df = spark.createDataFrame(own, "k bigint, card int, t bigint").withColumn("t", F.timestamp_micros("t"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("k bigint, card int, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    told = live_time_since_previous(stream, "card", "t", "k", "10 minutes")
    query = (
        told.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {r["k"]: r["time_diff"] for r in spark.read.parquet(f"{folder}/out").collect()}
    want = pdf.sort_values(["card", "t", "k"])
    want["gap"] = want.groupby("card").t.diff() / 1e6
    closed = want[want.t < at.max() - 600_000_000]
    expected = {int(r.k): None if r.card is pd.NA or np.isnan(r.gap) else r.gap for r in closed.itertuples()}
    assert got == expected and len(got) > 1_000


def test_points_keep_the_ranking(scored):
    from tidemark.operators.ranking import point_metrics, score_points

    full = ranking_metrics(scored, group=["period"])
    assert table_of(point_metrics(score_points(scored, group=["period"]), ["period"], 50)) == table_of(full)
