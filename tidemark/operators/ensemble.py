"""Ensemble of classifiers: fit, calibrate, weight, combine."""

from __future__ import annotations

import json
import logging
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import pick
from tidemark.operators.boosting import Binned, HistogramBooster
from tidemark.operators.drift import DriftValidator
from tidemark.operators.learners import (
    assemble,
    fit_boosted,
    load_learner,
    make_learner,
    save_learner,
    weighted_mean,
    with_probability,
)
from tidemark.operators.order import bucket_bounds, with_bucket
from tidemark.operators.ranking import ranking_metrics
from tidemark.operators.splits import stratified_folds
from tidemark.params import DEFAULT_MEMBERS
from tidemark.session import drop_table, write_table

log = logging.getLogger(__name__)

def calibration_points(df: DataFrame, label: str, prob: str, bins: int | None = None) -> DataFrame:
    """(prob, label, weight) with equal scores pooled, which leaves an isotonic fit
    unchanged. Spark's isotonic learner ends on one node; ``bins`` pools the scores into so
    many equal-count buckets, where every row keeps its weight. It is the caller's choice:
    the number of rows never changes the fit."""
    score, y = F.col(prob).cast("double"), F.col(label).cast("double")
    if bins is None:
        return df.groupBy(score.alias("prob")).agg(
            F.avg(y).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
        )
    rows = df.select(score.alias("prob"), y.alias("label"))
    bounds = bucket_bounds(rows, "prob", max(1, -(-df.count() // bins)))
    return (
        with_bucket(rows, "prob", bounds, "_bucket")
        .groupBy("_bucket")
        .agg(
            F.avg("prob").alias("prob"),
            F.avg("label").alias("label"),
            F.count(F.lit(1)).cast("double").alias("weight"),
        )
        .drop("_bucket")
    )


def fit_isotonic(df: DataFrame, label: str, prob: str, bins: int | None = None) -> IsotonicRegressionModel:
    learner = IsotonicRegression(featuresCol="prob", labelCol="label", weightCol="weight")
    # The learner reads its points twice: they are pooled once.
    points = write_table(calibration_points(df, label, prob, bins), "calibration-points")
    model = learner.fit(points)
    drop_table(points)
    return model


def apply_isotonic(df: DataFrame, model: IsotonicRegressionModel, prob: str, out: str) -> DataFrame:
    return model.transform(df, {model.getParam("featuresCol"): prob, model.getParam("predictionCol"): out})


def auc_weights(auc: dict[str, float], stability: dict[str, float] | None = None) -> dict[str, float]:
    """Weights in proportion to AUC, summing to 1. Extension: ``stability`` multiplies
    each AUC by the member's mean stability over drift periods."""
    raw = {n: a * (stability or {}).get(n, 1.0) for n, a in auc.items()}
    total = sum(raw.values())
    return {n: v / total for n, v in raw.items()}


def weights_table(members: DataFrame) -> DataFrame:
    """(member, weight) from (member, auc): the same rule over a table of metrics."""
    total = members.agg(F.sum("auc").alias("total")).scalar()
    return members.select("member", "auc", (F.col("auc") / total).alias("weight"))


def stability_weights(periods: DataFrame) -> DataFrame:
    """Extension: (member, weight) from (member, auc) rows per period. A member's mean AUC
    is discounted by its spread over the periods, so weight moves to members that hold
    up under drift."""
    raw = periods.groupBy("member").agg((F.avg("auc") * (1.0 - F.stddev_pop("auc"))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total")).scalar()
    return raw.select("member", (F.col("raw") / total).alias("weight"))


def disagreement(columns: Sequence[str]) -> Column:
    """Extension: population deviation of the member probabilities of one row."""
    n = float(len(columns))
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / n
    return F.sqrt(sum((F.pow(F.col(c) - mean, 2) for c in columns), F.lit(0.0)) / n)


def long_probabilities(df: DataFrame, keep: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """The kept columns with (member, prob) for each member and its column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("member"), F.col(c).alias("prob")) for n, c in columns.items()])
    return df.select(*keep, F.explode(pairs).alias("m")).select(*keep, "m.*")


class _Ready:
    """Binned rows that boosted members share, by whether rows are held out and how many bins."""

    def __init__(self) -> None:
        self.kept: dict[tuple[bool, int], Binned] = {}
        self.lock = threading.Lock()

    def rows(self, learner: HistogramBooster, train: DataFrame, held: DataFrame | None) -> Binned:
        kind = held is not None, learner.params.bins
        with self.lock:
            if kind not in self.kept:
                self.kept[kind] = learner.binned(train, held)
            return self.kept[kind]

    def drop(self) -> None:
        for rows in self.kept.values():
            rows.drop()


class Ensemble:
    """Weighted mean of calibrated member probabilities."""

    def __init__(
        self,
        members: dict[str, dict] | None = None,
        calibrate: bool = True,
        calibration_mode: str = "prefit",
        seed: int = 42,
        max_rounds: int | None = None,
        parallelism: int = 1,
        calibration_bins: int | None = None,
    ) -> None:
        self.members = dict(DEFAULT_MEMBERS if members is None else members)
        for config in self.members.values():
            make_learner(config["type"], "label", seed, {})
        self.calibrate, self.calibration_mode, self.seed = calibrate, calibration_mode, seed
        self.max_rounds, self.parallelism, self.calibration_bins = max_rounds, parallelism, calibration_bins
        self.weights = {n: 1.0 / len(self.members) for n in self.members}
        self.performance: dict[str, dict[str, float]] = {}
        self.models: dict = {}
        self.calibrators: dict[str, list[tuple]] = {}
        self.failures: dict[str, str] = {}
        self.features: list[str] = []
        self.label = "isFraud"
        self.drift: DriftValidator | None = None

    # ------------------------------------------------------------------ fitting

    def _learner(self, name: str):
        config = self.members[name]
        params = dict(config.get("params", {}))
        if config["type"] == "gbt" and self.max_rounds is not None:
            params["maxIter"] = min(self.max_rounds, params.get("maxIter", self.max_rounds))
        if config["type"] == "boost" and self.max_rounds is not None:
            params["rounds"] = min(self.max_rounds, params.get("rounds", self.max_rounds))
        offset = list(self.members).index(name)
        return make_learner(config["type"], self.label, self.seed + offset, params)

    def _clone(self, name: str):
        """A learner like the fitted member's, with as many rounds as that one kept."""
        learner, model = self._learner(name), self.models[name]
        if self.members[name]["type"] == "boost":
            learner.params = replace(learner.params, rounds=max(1, model.best_round))
        elif self.members[name]["type"] == "gbt":
            learner.setMaxIter(model.getNumTrees)
        return learner

    def _fit_member(self, name: str, train: DataFrame, val: DataFrame, ready: _Ready):
        learner, config = self._learner(name), self.members[name]
        patience = config.get("early_stopping")
        if config["type"] == "boost":
            held = val if patience else None
            return learner.fit(train, held, patience, ready.rows(learner, train, held))
        if patience and config["type"] == "gbt" and learner.getMaxIter() > 1:
            return fit_boosted(learner, train, val, patience)[0]
        return learner.fit(train)

    def fit(self, train: DataFrame, val: DataFrame, features: Sequence[str], label: str, key: str) -> dict[str, float]:
        """Fit the members on ``train`` and calibrate and weight them on ``val``.

        In the "prefit" mode one half of ``val`` (stratified by hash) calibrates and the
        other half gives every reported number. "crossfit" refits each member on folds
        of ``val`` and then reports on the same rows, so its numbers are optimistic.

        Both frames are read many times: pass frames that are cheap to scan.
        """
        self.features, self.label = list(features), label
        columns = [key, label, "features"]
        train = assemble(train, features).select(*columns)
        val = assemble(val, features).select(*columns)
        split = self.calibrate and self.calibration_mode == "prefit"
        if split:
            halves = stratified_folds(val, label, key, 2, self.seed)
            calibration, check = halves.where(F.col("fold") == 0), halves.where(F.col("fold") == 1)
        else:
            calibration = check = val

        ready = _Ready()

        def attempt(name: str):
            try:
                return name, self._fit_member(name, train, check, ready), None
            except Exception as e:  # a failing member is reported and left out
                log.exception("member %s failed", name)
                return name, None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(self.parallelism) as pool:
            for name, model, error in pool.map(attempt, list(self.members)):
                if error is None:
                    self.models[name] = model
                else:
                    self.failures[name] = error
        ready.drop()
        if not self.models:
            raise ValueError(f"every member failed: {self.failures}")

        # Ranks and isotonic fits take several passes: every row is scored once.
        names = [f"prob_{n}" for n in self.models]
        raw = halves.withColumn("_check", F.col("fold") == 1) if split else check.withColumn("_check", F.lit(True))
        for name, model in self.models.items():
            raw = with_probability(raw, model, f"prob_{name}")
        raw = write_table(raw.select(label, "_check", *names), "member-scores")
        seen = raw.where("_check")
        metrics: dict[str, float] = {}
        for row in self._member_metrics(seen):
            name = row["member"]
            self.performance[name] = {"auc": row["auc"], "average_precision": row["average_precision"]}
            metrics[f"{name}_auc"], metrics[f"{name}_ap"] = row["auc"], row["average_precision"]
        if self.calibrate:
            self._calibrate(raw.where("NOT _check") if split else calibration, key)
        self.weights = auc_weights({n: p["auc"] for n, p in self.performance.items()})
        scored = self._combine(check) if self.calibrate and not split else self._weighted(self._calibrated(seen))
        combined = write_table(scored.select(label, "prob"), "ensemble-scores")
        final = ranking_metrics(combined, label, "prob").first()
        drop_table(combined)
        drop_table(raw)
        if final is None:
            raise ValueError("the validation rows hold one class only")
        metrics["ensemble_auc"], metrics["ensemble_ap"] = final["auc"], final["average_precision"]
        return metrics

    def _member_metrics(self, scored: DataFrame) -> list:
        """AUC and AP of all members in one job: scores in long form, grouped by member."""
        long = long_probabilities(scored, [self.label], {n: f"prob_{n}" for n in self.models})
        return ranking_metrics(long, self.label, "prob", ["member"]).collect()

    def _calibrate(self, rows: DataFrame, key: str) -> None:
        """Fit the calibrators: "prefit" on rows scored before, "crossfit" on assembled rows."""
        if self.calibration_mode == "prefit":
            for name in self.models:
                points = rows.select(self.label, F.col(f"prob_{name}").alias("prob"))
                self.calibrators[name] = [(None, fit_isotonic(points, self.label, "prob", self.calibration_bins))]
            return
        folded = stratified_folds(rows, self.label, key, 3, self.seed)
        for name in self.models:
            pairs = []
            for fold in range(3):
                clone = self._clone(name).fit(folded.where(F.col("fold") != fold))
                held = with_probability(folded.where(F.col("fold") == fold), clone, "prob")
                pairs.append((clone, fit_isotonic(held, self.label, "prob", self.calibration_bins)))
            self.calibrators[name] = pairs

    # ------------------------------------------------------------------ scoring

    def _calibrated(self, scored: DataFrame) -> DataFrame:
        """Member probabilities through the prefit calibrators, for rows scored before."""
        out = scored
        for name in self.models:
            for _, isotonic in self.calibrators.get(name, []):
                raw = f"_raw_{name}"
                out = apply_isotonic(out.withColumnRenamed(f"prob_{name}", raw), isotonic, raw, f"prob_{name}").drop(raw)
        return out

    def _weighted(self, scored: DataFrame) -> DataFrame:
        names = list(self.models)
        return scored.withColumn("prob", weighted_mean([f"prob_{n}" for n in names], [self.weights[n] for n in names]))

    def _combine(self, assembled: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("the ensemble has no members yet: fit it first")
        out = assembled
        for name, model in self.models.items():
            pairs = self.calibrators.get(name) or [(None, None)]
            parts = []
            for i, (clone, isotonic) in enumerate(pairs):
                raw, part = f"_raw_{name}_{i}", f"_part_{name}_{i}"
                out = with_probability(out, clone or model, raw)
                if isotonic is None:
                    part = raw
                else:
                    out = apply_isotonic(out, isotonic, raw, part)
                parts.append(part)
            out = out.withColumn(f"prob_{name}", sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts))
            out = out.drop(*[c for c in out.columns if c.startswith(("_raw_", "_part_"))])
        return self._weighted(out)

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Add ``prob_<member>`` for every member, ``prob`` and ``pred``."""
        return self._combine(assemble(df, self.features)).drop("features").withColumn("pred", pick(threshold))

    def contributions(self, df: DataFrame) -> DataFrame:
        """Member probabilities in long form: the input columns with (member, prob)."""
        return long_probabilities(self.predict(df), df.columns, {n: f"prob_{n}" for n in self.models})

    def detect_drift(self, domains: DataFrame) -> DataFrame:
        """Drift of domain 1 against domain 0, or a row that says no validator exists."""
        if self.drift is None:
            return domains.sparkSession.range(1).select(
                F.lit(False).alias("is_drift_detected"), F.lit("no drift validator was fitted").alias("message")
            )
        return self.drift.predict_drift(domains)

    def reweight(self, df: DataFrame, period: str = "period") -> dict[str, float]:
        """Extension: set the weights from the members' AUC and its spread over periods of
        engineered, labelled rows."""
        long = long_probabilities(self.predict(df), [self.label, period], {n: f"prob_{n}" for n in self.models})
        per = ranking_metrics(long, self.label, "prob", ["member", period])
        self.weights = {r["member"]: r["weight"] for r in stability_weights(per).collect()}
        return self.weights

    # -------------------------------------------------------------- persistence

    def save(self, path: str) -> None:
        """Members and calibrators with their own writers, the rest as one JSON row."""
        layout = {}
        for name, model in self.models.items():
            save_learner(model, f"{path}/members/{name}")
            layout[name] = []
            for i, (clone, isotonic) in enumerate(self.calibrators.get(name, [])):
                isotonic.write().overwrite().save(f"{path}/calibrators/{name}_{i}")
                if clone is not None:
                    save_learner(clone, f"{path}/clones/{name}_{i}")
                layout[name].append(clone is not None)
        if self.drift is not None:
            self.drift.save(f"{path}/drift")
        fields = (
            "members",
            "calibrate",
            "calibration_mode",
            "calibration_bins",
            "seed",
            "max_rounds",
            "parallelism",
            "weights",
            "performance",
            "failures",
            "features",
            "label",
        )
        body = {f: getattr(self, f) for f in fields} | {"layout": layout, "has_drift": self.drift is not None}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        body = json.loads(spark.read.text(f"{path}/state").first()["value"])
        layout, has_drift = body.pop("layout"), body.pop("has_drift")
        out = cls.__new__(cls)
        out.__dict__.update(body)
        out.models, out.calibrators, out.drift = {}, {}, None
        for name, clones in layout.items():
            kind = out.members[name]["type"]
            out.models[name] = load_learner(kind, f"{path}/members/{name}")
            if clones:
                out.calibrators[name] = [
                    (
                        load_learner(kind, f"{path}/clones/{name}_{i}") if cloned else None,
                        IsotonicRegressionModel.load(f"{path}/calibrators/{name}_{i}"),
                    )
                    for i, cloned in enumerate(clones)
                ]
        if has_drift:
            out.drift = DriftValidator.load(spark, f"{path}/drift")
        return out
