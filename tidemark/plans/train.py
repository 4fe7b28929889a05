"""Training, scoring and evaluation jobs of the drift-aware ensemble."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import nan_to_null
from tidemark.operators.drift import DriftValidator
from tidemark.operators.ensemble import Ensemble
from tidemark.operators.features import FeatureEngineer, FeatureModel
from tidemark.operators.joins import stack_domains
from tidemark.operators.profile import member_scores
from tidemark.operators.splits import drift_periods, half_split, stratified_folds, stratified_temporal_split
from tidemark.params import EvalParams, Roles, TrainParams
from tidemark.plans.evaluate import full_evaluation, temporal_metrics
from tidemark.session import cut_lineage, drop_table, write_table
from tidemark.sources.readers import read_optional
from tidemark.sources.sinks import (
    check_targets,
    dict_to_metrics,
    new_run_id,
    publish,
    read_json,
    union_metrics,
    wide_to_metrics,
    write_json,
    write_metrics,
    write_metrics_json,
    write_report,
)


@dataclass
class Prepared:
    """Engineered rows with ``split``, a table for each; training rows also carry ``period``."""

    train: DataFrame
    held: DataFrame
    features: list[str]
    model: FeatureModel

    @property
    def rows(self) -> DataFrame:
        return self.train.unionByName(self.held)

    @property
    def val(self) -> DataFrame:
        """Validation rows that calibrate, stop and weight."""
        return self.held.where(F.col("fold") < 2).drop("fold")

    @property
    def report(self) -> DataFrame:
        """Validation rows that nothing was fitted on."""
        return self.held.where(F.col("fold") == 2)


def prepare(df: DataFrame, roles: Roles, params: TrainParams, val: DataFrame | None = None) -> Prepared:
    """Split by time within each class, cut the training rows into periods, fit the
    features on them and transform both sides.

    The raw rows (often a join) and the engineered rows are each written once as columns:
    every fit, the learners, the validator and the metrics read a few columns of them. The
    raw copy is removed at the end. ``fold`` deals the validation rows by class into 0 and 1
    (calibration, stopping, weights) and 2 (reported metrics only).
    """
    df = raw = write_table(nan_to_null(df), "raw-rows")
    if val is None:
        split = stratified_temporal_split(df, roles.time, roles.key, roles.label, params.train_ratio)
        train = split.where(F.col("split") == "train").drop("split")
        val = split.where(F.col("split") == "test").drop("split")
    else:
        train = df
    model = FeatureEngineer(roles).fit(train)
    train = drift_periods(train, roles.time, roles.key, params.periods).withColumn("split", F.lit("train"))
    val = val.withColumns({"split": F.lit("val"), "period": F.lit(None).cast("int")})
    val = stratified_folds(val, roles.label, roles.key, 3)
    train = train.withColumn("fold", F.lit(None).cast("int"))
    # A table for each side: rows of the smaller one, read alone, are dealt to all cores too.
    train, held = (write_table(model.transform(part), "engineered-rows") for part in (train, val))
    drop_table(raw)
    return Prepared(train, held, model.feature_columns, model)


@dataclass
class DriftAwareScorer:
    """Fitted state of a training run."""

    roles: Roles
    features: FeatureModel
    ensemble: Ensemble
    validator: DriftValidator | None

    def predict(self, df: DataFrame, threshold: float = 0.5, drift: bool = False) -> DataFrame:
        """Raw rows in; key, member probabilities, ``prob`` and ``pred`` out, with the
        label and carried columns kept when present. ``drift`` adds ``drift_prob``."""
        scored = self.ensemble.predict(self.features.transform(df), threshold)
        extra = []
        if drift and self.ensemble.drift is not None:
            scored, extra = self.ensemble.drift.score(scored), ["drift_prob"]
        kept = [c for c in self.roles.reserved() if c in df.columns and c != self.roles.key]
        names = [f"prob_{n}" for n in self.ensemble.models]
        return scored.select(self.roles.key, *kept, *names, "prob", "pred", *extra)

    def evaluate_drift(self, new: DataFrame, reference: DataFrame) -> DataFrame:
        """Drift of raw new rows against raw reference rows."""
        if self.validator is None:
            raise ValueError("this scorer has no drift validator: train it with two periods or more")
        return self.validator.predict_drift(
            stack_domains(
                self.features.transform(reference), self.features.transform(new), self.roles.reserved(), (self.roles.key,)
            )
        )

    def save(self, path: str, params: TrainParams | None = None) -> str:
        """Write a versioned run folder whole, then publish it as the latest in one step; returns
        the run id. A save that breaks off leaves the run published before."""
        spark = SparkSession.active()
        run_id = new_run_id()
        base = f"{path}/run_id={run_id}"
        self.features.save(f"{base}/features")
        self.ensemble.save(f"{base}/ensemble")
        if self.validator is not None:
            self.validator.save(f"{base}/validator")
        write_json(spark, {"params": asdict(params) if params else None, "roles": asdict(self.roles)}, f"{base}/config")
        publish(spark, {"run_id": run_id, "validator": self.validator is not None}, f"{path}/latest.json")
        return run_id

    @classmethod
    def load(cls, spark: SparkSession, path: str, run_id: str | None = None) -> DriftAwareScorer:
        run_id = run_id or read_json(spark, f"{path}/latest.json")["run_id"]
        base = f"{path}/run_id={run_id}"
        features = FeatureModel.load(f"{base}/features")
        has_validator = read_optional(spark, f"{base}/validator/state", "text") is not None
        return cls(
            features.roles,
            features,
            Ensemble.load(spark, f"{base}/ensemble"),
            DriftValidator.load(spark, f"{base}/validator") if has_validator else None,
        )


def _drift_features(features: list[str], roles: Roles, params: TrainParams) -> list[str]:
    """The time column tells early from late by itself, so it is left out by default."""
    exclude = (roles.time,) if params.drift_exclude is None else params.drift_exclude
    return [c for c in features if c not in exclude]


def train(
    df: DataFrame,
    roles: Roles = Roles(),
    params: TrainParams = TrainParams(),
    eval_params: EvalParams = EvalParams(),
    val: DataFrame | None = None,
    out: str | None = None,
) -> tuple[DriftAwareScorer, DataFrame]:
    """The whole job: prepare, fit the ensemble and the drift validators, evaluate, save.
    Returns the scorer and the metric table."""
    started = time.monotonic()
    spark = df.sparkSession
    if df.isEmpty():
        raise ValueError("no training rows")
    data = prepare(df, roles, params, val)
    ensemble = Ensemble(
        params.members, params.calibrate, params.calibration_mode, params.seed, params.max_rounds, params.parallelism
    )
    fitted = ensemble.fit(data.train, data.val, data.features, roles.label, roles.key)
    metrics = [dict_to_metrics(spark, fitted, "train")]
    metrics.append(dict_to_metrics(spark, {f"weight_{n}": w for n, w in ensemble.weights.items()}, "train"))

    validator = None
    if params.periods > 1:
        columns = _drift_features(data.features, roles, params)
        learner = dict(
            learner=params.drift_learner,
            seed=params.seed,
            threshold=params.drift_threshold,
            params={"boost": {"rounds": params.drift_rounds}, "gbt": {"maxIter": params.drift_rounds}}.get(params.drift_learner, {}),
        )
        first_vs_rest = data.train.withColumn("domain", (F.col("period") > 0).cast("int"))
        ensemble.drift = DriftValidator(**learner)
        ensemble.drift.fit(first_vs_rest, columns, roles.key, params.drift_holdout)
        halves = half_split(data.train, roles.time, roles.key)
        validator = DriftValidator(**learner)
        found = validator.fit(halves, columns, roles.key, params.drift_holdout, ensemble.drift)
        metrics.append(dict_to_metrics(spark, {f"adversarial_{k}": v for k, v in found.items()}, "train"))

    scorer = DriftAwareScorer(roles, data.model, ensemble, validator)
    metrics.append(_evaluate_run(data, ensemble, roles, eval_params))
    table = cut_lineage(union_metrics(metrics))
    if out is not None:
        run_id = scorer.save(out, params)
        write_metrics(table, f"{out}/metrics", run_id)
        write_metrics_json(table, f"{out}/run_id={run_id}/training_metrics")
    elapsed = dict_to_metrics(spark, {"training_time_seconds": time.monotonic() - started}, "train")
    return scorer, table.unionByName(elapsed)


def _evaluate_run(data: Prepared, ensemble: Ensemble, roles: Roles, params: EvalParams) -> DataFrame:
    """Metrics on the validation rows that nothing was fitted on, per-period stability on the
    training rows and the drift detector's quality, all from one scored frame that is
    written once."""
    scored = ensemble.predict(data.train.unionByName(data.report), params.threshold)
    names = [f"prob_{n}" for n in ensemble.models]
    if ensemble.drift is not None:
        scored = ensemble.drift.score(scored)
    extra = ["drift_prob"] if ensemble.drift is not None else []
    scored = write_table(
        scored.select(roles.key, roles.label, "split", "period", *names, "prob", "pred", *extra), "scored-rows"
    )
    val, periods = scored.where(F.col("split") == "val"), scored.where(F.col("split") == "train")
    parts = [full_evaluation(val, roles.key, roles.label, params, scope="validation")]
    members = member_scores(val, names).withColumn("feature", F.substring(F.col("feature"), 6, 1000))
    parts.append(wide_to_metrics(members, "validation", "feature", "contribution_"))
    if ensemble.drift is not None:
        parts.append(temporal_metrics(periods, roles.label, "period", _candidate_scores(periods), "periods"))
    return union_metrics(parts)


def _candidate_scores(scored: DataFrame) -> DataFrame:
    """Mean drift probability of each period after the first, which is the reference."""
    later = scored.where(F.col("period") > 0)
    return later.groupBy("period").agg(F.avg("drift_prob").alias("drift_score"))


def evaluate(
    scorer: DriftAwareScorer,
    df: DataFrame,
    params: EvalParams = EvalParams(),
    periods: int | None = None,
    out: str | None = None,
    scope: str = "test",
) -> DataFrame:
    """Standard, drift and calibration evaluation of a fitted scorer on raw labelled rows."""
    roles = scorer.roles
    rows = drift_periods(df, roles.time, roles.key, periods) if periods else df
    scored = write_table(scorer.predict(rows, params.threshold, drift=periods is not None), "scored-rows")
    candidates = None
    if "drift_prob" in scored.columns:
        candidates = _candidate_scores(scored)
    metrics = cut_lineage(
        full_evaluation(scored, roles.key, roles.label, params, "period" if periods else None, candidates, scope)
    )
    if out is not None:
        write_report(metrics, out)
        check_targets(metrics, params.targets).coalesce(1).write.mode("overwrite").json(f"{out}/targets")
    return metrics


def train_and_test(
    train_rows: DataFrame,
    test_rows: DataFrame,
    roles: Roles = Roles(),
    params: TrainParams = TrainParams(),
    eval_params: EvalParams = EvalParams(),
    out: str | None = None,
) -> tuple[DriftAwareScorer, DataFrame]:
    """Train, score the labelled test rows, evaluate them and check the targets. The final
    table holds the training metrics and the test metrics prefixed with ``test_``."""
    spark = train_rows.sparkSession
    scorer, trained = train(train_rows, roles, params, eval_params, out=out)
    tested = evaluate(scorer, test_rows, eval_params)
    final = cut_lineage(
        trained.unionByName(tested.withColumn("metric", F.concat(F.lit("test_"), F.col("metric"))))
    )
    if out is not None:
        write_metrics_json(final, f"{out}/results/metrics")
        check_targets(tested, eval_params.targets).coalesce(1).write.mode("overwrite").json(f"{out}/results/targets")
        body = {"params": asdict(params), "evaluation": asdict(eval_params), "roles": asdict(roles)}
        write_json(spark, body, f"{out}/results/config")
    return scorer, final
