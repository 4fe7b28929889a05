"""Drift detection: a domain classifier tells earlier rows from later ones."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio_or_zero
from tidemark.operators.boosting import HistogramBooster
from tidemark.operators.classification import one_row
from tidemark.operators.learners import assemble, importance_table, load_learner, make_learner, save_learner, with_probability
from tidemark.operators.ranking import ranking_metrics
from tidemark.operators.splits import random_holdout
from tidemark.session import drop_table, write_table

# Threshold sweep of the detector evaluation and its fallback.
SWEEP_LOW, SWEEP_HIGH, SWEEP_STEPS, SWEEP_FALLBACK = 0.3, 0.9, 100, 0.6


def sweep_thresholds() -> list[float]:
    step = (SWEEP_HIGH - SWEEP_LOW) / (SWEEP_STEPS - 1)
    return [SWEEP_LOW + i * step for i in range(SWEEP_STEPS - 1)] + [SWEEP_HIGH]


# Fixed value: words a caller may look for.
NOT_FITTED = "Model not fitted"

class DriftValidator:
    """Domain classifier over a frame with ``domain`` 0 (reference) and 1 (new)."""

    def __init__(self, learner: str = "boost", seed: int = 42, threshold: float = 0.6, params: dict | None = None) -> None:
        self.learner, self.seed, self.threshold, self.params = learner, seed, threshold, params or {}
        self.model = None
        self.features: list[str] = []

    def rows(self, domains: DataFrame, features: Sequence[str], key: str, holdout: float = 0.2) -> DataFrame:
        """What a fit reads: key, assembled features, domain and the hash-based share. Validators
        of the same seed can share them, kept by the caller."""
        return random_holdout(assemble(domains, features), key, holdout, self.seed).select(
            key, "features", "domain", "holdout"
        )

    def fit(
        self,
        domains: DataFrame,
        features: Sequence[str],
        key: str,
        holdout: float = 0.2,
        like: DriftValidator | None = None,
        ready: DataFrame | None = None,
    ) -> dict[str, float]:
        """Fit on a hash-based share of the rows; AUC on both shares from one scoring pass.
        The learner reads ``domains`` many times: pass a frame that is cheap to scan. ``like`` was
        fitted on the same features, rows and share with other domains: its bins are taken over.
        ``ready`` are the ``rows`` of these very arguments; they stay."""
        learner = make_learner(self.learner, "domain", self.seed, self.params)
        self.features = list(features)
        if ready is not None:
            return self._fit(learner, ready, like)
        rows = self.rows(domains, features, key, holdout)
        if isinstance(learner, HistogramBooster):  # writes its bins from one scan
            return self._fit(learner, rows, like)
        # Spark ML scans them for the size, the cuts, its own copy and the scores: assembled once.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(learner, rows, like)
        finally:
            rows.unpersist()

    def _fit(self, learner, rows: DataFrame, like: DriftValidator | None) -> dict[str, float]:
        own = rows.where(F.col("holdout") == 0)
        if like is not None and isinstance(learner, HistogramBooster):
            ready = learner.binned(own, cuts=like.model.cuts)
            self.model = learner.fit(own, ready=ready)
            ready.drop()
        else:
            self.model = learner.fit(own)
        # The ranks take several passes: every row is scored once.
        scored = write_table(with_probability(rows, self.model, "prob").select("domain", "prob", "holdout"), "drift-scores")
        auc = {r["holdout"]: r["auc"] for r in ranking_metrics(scored, "domain", "prob", ["holdout"]).collect()}
        drop_table(scored)
        if set(auc) != {0, 1}:
            raise ValueError("a domain is missing from the training or the held-out rows")
        return {"train_auc": auc[0], "val_auc": auc[1], "drift_auc": auc[1]}

    def _require(self) -> None:
        if self.model is None:
            raise ValueError(f"{NOT_FITTED}: fit the validator before it scores")

    def score(self, df: DataFrame, name: str = "drift_prob") -> DataFrame:
        """Add the probability that a row belongs to the new domain."""
        self._require()
        return with_probability(assemble(df, self.features), self.model, name).drop("features")

    def predict_drift(self, domains: DataFrame) -> DataFrame:
        """One row: mean scores per domain, their difference, the AUC and the flag."""
        scored = write_table(self.score(domains).select("domain", "drift_prob"), "drift-scores")
        prob, new = F.col("drift_prob"), F.col("domain") == 1
        means = scored.agg(
            F.avg(F.when(new, prob)).alias("drift_mean_score"),
            F.avg(F.when(~new, prob)).alias("reference_mean_score"),
        )
        auc = ranking_metrics(scored, "domain", "drift_prob").select(F.col("auc").alias("drift_auc"))
        return one_row([means, auc]).select(
            "drift_mean_score",
            "drift_auc",
            (F.col("drift_mean_score") > self.threshold).alias("is_drift_detected"),
            "reference_mean_score",
            (F.col("drift_mean_score") - F.col("reference_mean_score")).alias("score_difference"),
        )

    def period_scores(self, df: DataFrame, period: str = "period") -> DataFrame:
        """Mean score per period: all periods in one pass."""
        return self.score(df).groupBy(period).agg(F.avg("drift_prob").alias("drift_score"))

    def top_features(self, spark: SparkSession, k: int = 10) -> DataFrame:
        """(feature, importance), highest first; empty while unfitted."""
        rows = importance_table(self.model, self.features)[:k] if self.model is not None else []
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        self._require()
        save_learner(self.model, f"{path}/model")
        body = {k: getattr(self, k) for k in ("learner", "seed", "threshold", "params", "features")}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DriftValidator:
        body = json.loads(spark.read.text(f"{path}/state").first()["value"])
        features = body.pop("features")
        out = cls(**body)
        out.features = features
        out.model = load_learner(out.learner, f"{path}/model")
        return out


def _candidates(scores: DataFrame, period: str, score: str) -> DataFrame:
    """(prob, label): the later half of the candidate periods counts as drifted. One row
    per period, so ordering them is a small job."""
    everything = Window.partitionBy(F.lit(0))
    position = F.row_number().over(everything.orderBy(period)) - 1
    half = F.floor(F.count(F.lit(1)).over(everything) / 2)
    return scores.select(F.col(score).alias("prob"), (position >= half).cast("int").alias("label"))


def threshold_sweep(scores: DataFrame, period: str = "period", score: str = "drift_score") -> DataFrame:
    """Confusion counts and rates of the candidates at every threshold of the sweep, and
    at the fallback threshold (``fallback`` true)."""
    grid = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.lit(False).alias("fallback")) for t in sweep_thresholds()],
        F.struct(F.lit(SWEEP_FALLBACK).alias("threshold"), F.lit(True).alias("fallback")),
    )
    flagged, drifted = F.col("prob") > F.col("g.threshold"), F.col("label") == 1
    precision, recall = F.col("precision"), F.col("recall")
    return (
        _candidates(scores, period, score)
        .select("prob", "label", F.explode(grid).alias("g"))
        .groupBy("g.threshold", "g.fallback")
        .agg(
            F.count_if(drifted & flagged).alias("tp"),
            F.count_if(~drifted & flagged).alias("fp"),
            F.count_if(drifted & ~flagged).alias("fn"),
            F.count_if(~drifted & ~flagged).alias("tn"),
        )
        .withColumns(
            {
                "recall": ratio_or_zero("tp", F.col("tp") + F.col("fn")),
                "precision": ratio_or_zero("tp", F.col("tp") + F.col("fp")),
                "specificity": ratio_or_zero("tn", F.col("tn") + F.col("fp")),
            }
        )
        .withColumn("f1", ratio_or_zero(2.0 * precision * recall, precision + recall))
    )


def detection_metrics(scores: DataFrame, period: str = "period", score: str = "drift_score") -> DataFrame:
    """Quality of drift detection over candidate periods, one row each in ``scores``.

    The sweep picks the best F1, the lowest threshold on a tie; the fallback holds when
    no threshold has any. With one class all metrics are 0.
    """
    sweep = threshold_sweep(scores, period, score)
    rank = F.struct(
        F.when(F.col("fallback"), 0.0).otherwise(F.col("f1")).alias("f1"), (-F.col("threshold")).alias("low")
    )
    best = sweep.where(F.col("fallback") | (F.col("f1") > 0)).agg(
        F.max_by(F.struct("recall", "precision", "specificity", "f1", "threshold"), rank).alias("b"),
        F.max((F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp"))).alias("both"),
    )
    auc = ranking_metrics(_candidates(scores, period, score)).select("auc").agg(F.max("auc").alias("auc"))
    both = F.coalesce(F.col("both") > 0, F.lit(False))

    def held(c: str) -> Column:
        return F.when(both, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)

    return one_row([best, auc]).select(
        held("b.recall").alias("drift_detection_recall"),
        held("b.precision").alias("drift_detection_precision"),
        held("b.specificity").alias("drift_detection_specificity"),
        held("auc").alias("drift_detection_auc"),
        held("b.f1").alias("drift_detection_f1"),
        F.when(both, F.col("b.threshold")).alias("drift_threshold"),
    )
