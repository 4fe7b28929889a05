"""Job parameters from a nested configuration (JSON, or YAML where a parser is installed)."""

from __future__ import annotations

import json
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from tidemark.params import DEFAULT_MEMBERS, EvalParams, Roles, TrainParams

log = logging.getLogger(__name__)

# Configuration keys by section and the parameter each one sets.
TRAINING_KEYS = {
    "random_seed": "seed",
    "train_ratio": "train_ratio",
    "n_drift_periods": "periods",
    "calibrate_probabilities": "calibrate",
}
EVALUATION_KEYS = {
    "calibration_bins": "bins",
    "business_cost_fp": "cost_fp",
    "business_cost_fn": "cost_fn",
}
ROLE_KEYS = {"time_column": "time", "id_column": "key", "target_column": "label"}

# Learner names and settings of the common boosting libraries, and the learner
# and setting here that answer to them.
LEARNER_NAMES = {
    "lightgbm": ("boost", {"grow": "leaf", "leaves": 31}),
    "xgboost": ("boost", {"grow": "depth", "depth": 6, "min_rows": 1, "min_hessian": 1.0, "l2": 1.0}),
    "catboost": ("boost", {"grow": "oblivious", "depth": 6, "l2": 3.0}),
    "boost": ("boost", {}),
    "gbt": ("gbt", {}),
    "rf": ("rf", {}),
    "logreg": ("logreg", {}),
}
SETTING_NAMES = {
    "boost": {
        "learning_rate": "rate",
        "n_estimators": "rounds",
        "iterations": "rounds",
        "num_leaves": "leaves",
        "max_depth": "depth",
        "depth": "depth",
        "subsample": "row_share",
        "bagging_fraction": "row_share",
        "bagging_freq": "row_every",
        "feature_fraction": "column_share",
        "colsample_bytree": "column_share",
        "l2_leaf_reg": "l2",
        "reg_lambda": "l2",
        "min_child_samples": "min_rows",
        "min_data_in_leaf": "min_rows",
        "min_child_weight": "min_hessian",
        "max_bin": "bins",
    },
    "gbt": {
        "learning_rate": "stepSize",
        "n_estimators": "maxIter",
        "max_depth": "maxDepth",
        "subsample": "subsamplingRate",
        "min_samples_leaf": "minInstancesPerNode",
        "feature_fraction": "featureSubsetStrategy",
    },
    "rf": {
        "n_estimators": "numTrees",
        "max_depth": "maxDepth",
        "subsample": "subsamplingRate",
        "min_samples_leaf": "minInstancesPerNode",
        "feature_fraction": "featureSubsetStrategy",
    },
    "logreg": {},
}
# Settings that Spark ML takes as text.
TEXT_SETTINGS = ("featureSubsetStrategy",)


# Metrics of which less is better; all others are better when they grow.
LOWER_WORDS = ("ece", "mce", "brier", "hl", "loss", "cost", "alarm", "std", "cv", "chi2", "error", "fpr", "fp", "fn", "disagreement")


def direction(metric: str) -> str:
    """``lower`` or ``higher``: which way a metric meets its target. What follows ``_at_`` is
    the operating point, not the metric."""
    return "lower" if set(metric.lower().split("_at_")[0].split("_")) & set(LOWER_WORDS) else "higher"


def target_from_config(metric: str, value) -> tuple[float, str]:
    """A number, or ``{"value": x, "direction": "lower" | "higher"}``."""
    if not isinstance(value, dict):
        return float(value), direction(metric)
    way = value.get("direction", direction(metric))
    if way not in ("lower", "higher"):
        raise ValueError(f"target {metric}: direction is lower or higher, not {way!r}")
    return float(value["value"]), way


def member_from_config(name: str, config: dict, patience: int | None) -> dict:
    """One ensemble member; settings the learner has no counterpart for are reported."""
    kind = config.get("type") or config.get("model_type") or name
    if kind not in LEARNER_NAMES:
        raise ValueError(f"no learner stands in for {kind!r}; known: {sorted(LEARNER_NAMES)}")
    own, preset = LEARNER_NAMES[kind]
    names, params = SETTING_NAMES[own], dict(preset)
    for key, value in config.get("params", {}).items():
        setting = names.get(key, key if kind == own else None)
        if setting is None:
            log.warning("member %s: no counterpart for setting %s", name, key)
        else:
            params[setting] = str(value) if setting in TEXT_SETTINGS else value
    member = {"type": own, "params": params}
    if own in ("boost", "gbt") and patience:
        member["early_stopping"] = patience
    return member


def params_from_config(config: dict) -> tuple[Roles, TrainParams, EvalParams]:
    """Roles and parameters of a configuration with the sections training, data,
    evaluation and base_models. Keys that set nothing are reported."""
    known = {"training": TRAINING_KEYS, "evaluation": EVALUATION_KEYS, "data": ROLE_KEYS}
    extra = {
        "training": {"target_column", "early_stopping_rounds"},
        "evaluation": {"target_metrics", "drift_threshold"},
        "data": {"data_path"},
    }
    for section, keys in known.items():
        for key in config.get(section, {}):
            if key not in keys and key not in extra[section]:
                log.warning("configuration key %s.%s sets nothing", section, key)
    training, evaluation, data = (config.get(s, {}) for s in ("training", "evaluation", "data"))
    roles = replace(Roles(), **{ROLE_KEYS[k]: v for k, v in data.items() if k in ROLE_KEYS})
    if "target_column" in training:
        roles = replace(roles, label=training["target_column"])

    fields = {TRAINING_KEYS[k]: v for k, v in training.items() if k in TRAINING_KEYS}
    if "drift_threshold" in evaluation:
        fields["drift_threshold"] = evaluation["drift_threshold"]
    patience = training.get("early_stopping_rounds", 50)
    if config.get("base_models"):
        fields["members"] = {n: member_from_config(n, c, patience) for n, c in config["base_models"].items()}
    else:
        fields["members"] = dict(DEFAULT_MEMBERS)

    checks = {EVALUATION_KEYS[k]: v for k, v in evaluation.items() if k in EVALUATION_KEYS}
    if "target_metrics" in evaluation:
        checks["targets"] = {m: target_from_config(m, t) for m, t in evaluation["target_metrics"].items()}
    return roles, TrainParams(**fields), EvalParams(**checks)


def read_config(spark: SparkSession, path: str) -> dict:
    """The configuration file, through Spark's file systems so that any path works."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML parser; use JSON instead") from e
        return yaml.safe_load(text)
    return json.loads(text)
