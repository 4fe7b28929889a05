import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.learners import assemble, make_learner, with_probability
from tidemark.operators.ranking import ranking_metrics
from tidemark.operators.search import Search, grid, survivors, time_folds

GRID = grid({"regParam": [10.0, 0.01], "elasticNetParam": [0.0, 1.0]})


@pytest.fixture
def folded(rows):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(int)
    data = [(i, float(i // 3), int(y[i]), *map(float, x[i])) for i in range(n)]
    df = rows(data, "key bigint, time double, label int, a double, b double, c double", 1)
    return time_folds(df, "time", "key", 2).cache()


def exhaustive(folded, candidate, budget):
    found = []
    for f in (1, 2):
        ready = assemble(folded, ["a", "b", "c"])
        model = make_learner("logreg", "label", 42, {**candidate, "maxIter": budget}).fit(ready.where(F.col("fold") < f))
        scored = with_probability(ready.where(F.col("fold") == f), model, "prob")
        found.append(ranking_metrics(scored).first()["auc"])
    return sum(found) / 2


def test_grid_and_survivors():
    assert grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert survivors({0: 0.5, 1: 0.7, 2: None, 3: 0.7}, 0.5) == [1, 3]
    assert survivors({0: None}, 0.1) == [0]
    assert survivors({0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}, 0.3) == [3, 2]


def test_folds_are_ordered_in_time(folded):
    spans = folded.groupBy("fold").agg(F.min(F.struct("time", "key")).alias("lo"), F.max(F.struct("time", "key")).alias("hi"), F.count("*").alias("n"))
    found = spans.orderBy("fold").collect()
    assert [r["n"] for r in found] == [200] * 3
    assert all(a["hi"] < b["lo"] for a, b in zip(found, found[1:]))


def test_one_budget_is_an_exhaustive_search(spark, folded):
    search = Search(GRID, "logreg", budgets=(20,)).fit(folded, ["a", "b", "c"], "label")
    want = [exhaustive(folded, c, 20) for c in GRID]
    got = {r["candidate"]: r for r in search.table(spark).collect()}
    assert [got[i]["mean_auc"] for i in range(4)] == pytest.approx(want)
    assert search.best == GRID[max(range(4), key=lambda i: (want[i], -i))]
    assert [r["kept"] for r in got.values()].count(True) == 1


def test_halving_drops_the_worse_half_and_no_other(spark, folded):
    search = Search(GRID, "logreg", budgets=(2, 20), keep=0.5).fit(folded, ["a", "b", "c"], "label")
    rows = search.table(spark).collect()
    first = {r["candidate"]: r["mean_auc"] for r in rows if r["rung"] == 0}
    assert first == pytest.approx({i: exhaustive(folded, c, 2) for i, c in enumerate(GRID)})
    kept = set(survivors(first, 0.5))
    second = {r["candidate"]: r["mean_auc"] for r in rows if r["rung"] == 1}
    assert set(second) == kept == {r["candidate"] for r in rows if r["rung"] == 0 and r["kept"]}
    assert second == pytest.approx({i: exhaustive(folded, GRID[i], 20) for i in kept})
    assert search.best == GRID[min(kept, key=lambda i: (-second[i], i))]


def test_boosted_candidates(spark, folded):
    search = Search([{"grow": "depth", "depth": 1, "rate": 1e-6}, {"grow": "depth", "depth": 3, "rate": 0.3}], budgets=(2, 4), keep=0.5)
    search.fit(folded, ["a", "b", "c"], "label")
    assert search.best["depth"] == 3 and len(search.trials) == 3


def test_folds_with_one_class_do_not_count(spark, folded):
    odd = folded.withColumn("label", F.when(F.col("fold") == 2, 0).otherwise(F.col("label")))
    search = Search(GRID[:1], "logreg", budgets=(5,)).fit(odd, ["a", "b", "c"], "label")
    assert search.table(spark).first()["folds"] == 1


def test_bad_searches():
    for bad in ({"candidates": []}, {"candidates": [{}], "budgets": (5, 2)}, {"candidates": [{}], "keep": 0.0}):
        with pytest.raises(ValueError):
            Search(**bad)
    with pytest.raises(ValueError):
        time_folds(None, "t", "k", 0)
