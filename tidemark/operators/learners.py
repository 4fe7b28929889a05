"""Learners by type name, and the helpers all model families share: boosted trees over
histograms (``boost``), and Spark ML's gradient-boosted trees, forest and logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.boosting import BoostedTrees, HistogramBooster, booster

_ESTIMATORS = {"gbt": GBTClassifier, "rf": RandomForestClassifier, "logreg": LogisticRegression}
_MODELS = {"gbt": GBTClassificationModel, "rf": RandomForestClassificationModel, "logreg": LogisticRegressionModel}

# Learner settings used when a configuration gives none.
_DEFAULTS = {
    "boost": {"grow": "leaf", "leaves": 31, "rounds": 100, "rate": 0.05, "row_share": 0.8, "row_every": 5, "column_share": 0.9},
    "gbt": {"maxDepth": 5, "maxIter": 100, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9"},
    "rf": {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2},
    "logreg": {"maxIter": 50, "regParam": 0.01},
}


def make_learner(kind: str, label: str, seed: int, params: dict | None = None) -> Estimator | HistogramBooster:
    if kind not in _DEFAULTS:
        raise ValueError(f"no learner called {kind!r}; known: {sorted(_DEFAULTS)}")
    if kind == "boost":
        # Settings of one way to grow are no defaults of another.
        return booster(label, seed, {**(_DEFAULTS[kind] if "grow" not in (params or {}) else {}), **(params or {})})
    settings = {**_DEFAULTS[kind], **(params or {})}
    if kind != "logreg":
        settings.setdefault("seed", seed)
        settings.setdefault("checkpointInterval", 10)
    return _ESTIMATORS[kind](featuresCol="features", labelCol=label, **settings)


def save_learner(model: Model | BoostedTrees, path: str) -> None:
    if isinstance(model, BoostedTrees):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_learner(kind: str, path: str) -> Model | BoostedTrees:
    if kind not in _DEFAULTS:
        raise ValueError(f"no learner called {kind!r}; known: {sorted(_DEFAULTS)}")
    if kind == "boost":
        return BoostedTrees.load(SparkSession.active(), path)
    return _MODELS[kind].load(path)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def with_probability(df: DataFrame, model: Model | BoostedTrees, name: str) -> DataFrame:
    """Add the class-1 probability as a double column and drop the model's own columns."""
    if isinstance(model, BoostedTrees):
        return model.score(df, name)
    scratch = {
        model.getParam("probabilityCol"): "_probability",
        model.getParam("rawPredictionCol"): "_raw",
        model.getParam("predictionCol"): "_prediction",
    }
    scored = model.transform(df, scratch)
    return scored.withColumn(name, vector_to_array("_probability")[1]).drop(*scratch.values())


def fit_boosted(
    learner: GBTClassifier, train: DataFrame, val: DataFrame, patience: int, first_rounds: int | None = None
) -> tuple[GBTClassificationModel, int]:
    """Early stopping with patience on the validation loss, for Spark ML's boosted trees.
    (``HistogramBooster.fit`` stops without fitting anything twice.)

    Rounds are doubled until the best one lies ``patience`` rounds back, so a learner
    that stops early never pays for all rounds. The same seed grows the same trees, so
    the refit to the best round is a prefix of the longer model.
    """
    most = learner.getMaxIter()
    rounds = min(most, first_rounds or 2 * patience)
    while True:
        model = learner.copy({learner.maxIter: rounds}).fit(train)
        losses = model.evaluateEachIteration(val)
        best, stopped = best_round(losses, patience)
        if stopped or rounds >= most:
            break
        rounds = min(most, 2 * rounds)
    if best < rounds:
        model = learner.copy({learner.maxIter: best}).fit(train)
    return model, best


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """1-based round of the lowest loss before ``patience`` rounds without a better one,
    and whether that wait ran out."""
    best, at = float("inf"), 1
    for i, loss in enumerate(losses, start=1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            return at, True
    return at, False


def weighted_mean(columns: Sequence[str], weights: Sequence[float]) -> Column:
    total = float(sum(weights))
    out = F.lit(0.0)
    for c, w in zip(columns, weights):
        out = out + F.col(c) * F.lit(w / total)
    return out


def importance_table(model: Model | BoostedTrees, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance), highest first, ties by position; one entry per feature."""
    values = [float(v) for v in model.featureImportances.toArray()]
    ranked = sorted(range(len(values)), key=lambda i: (-values[i], i))
    return [(features[i], values[i]) for i in ranked]
