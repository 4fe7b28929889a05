"""Column roles and job parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType, StringType


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. The defaults are the public names of
    the card-transaction schema this package is a drop-in for."""

    key: str = "TransactionID"
    time: str = "TransactionDT"
    label: str = "isFraud"
    amount: str = "TransactionAmt"
    card: str = "card1"
    card_secondary: str = "card2"
    distances: tuple[str, str] = ("dist1", "dist2")
    carried: tuple[str, ...] = ("split", "period", "domain")  # labels of our own operators

    def reserved(self) -> tuple[str, ...]:
        """Columns that are never features: they pass through every transform."""
        return (self.label, self.key, *self.carried)

    def numeric(self, df: DataFrame) -> list[str]:
        return [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in self.reserved()
        ]

    def categorical(self, df: DataFrame) -> list[str]:
        return [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in self.reserved()
        ]

    def features(self, df: DataFrame) -> list[str]:
        """Every column but the reserved ones, in table order."""
        return [c for c in df.columns if c not in self.reserved()]


def family(df: DataFrame, prefix: str) -> list[str]:
    """Columns named by one prefix letter and digits, such as ``C1, C2, ...``."""
    return [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)]


# The member set and learner settings the ensemble starts from.
DEFAULT_MEMBERS: dict[str, dict] = {
    "boost_leafwise": {
        "type": "boost",
        "params": {"grow": "leaf", "leaves": 31, "rate": 0.05, "row_share": 0.8, "row_every": 5, "column_share": 0.9},
        "early_stopping": 50,
    },
    "boost_depth6": {
        "type": "boost",
        "params": {"grow": "depth", "depth": 6, "rate": 0.05, "row_share": 0.8, "min_rows": 1, "min_hessian": 1.0, "l2": 1.0},
        "early_stopping": 50,
    },
    "boost_oblivious": {
        "type": "boost",
        "params": {"grow": "oblivious", "depth": 6, "rate": 0.05, "l2": 3.0},
        "early_stopping": 50,
    },
}

# Metric targets and whether higher or lower is better.
DEFAULT_TARGETS: dict[str, tuple[float, str]] = {
    "auroc": (0.94, "higher"),
    "auprc": (0.65, "higher"),
    "drift_detection_recall": (0.85, "higher"),
    "calibration_ece": (0.03, "lower"),
}


def _unit(name: str, value: float) -> None:
    if not 0.0 < value < 1.0:
        raise ValueError(f"{name} must lie strictly between 0 and 1, got {value}")


@dataclass(frozen=True)
class TrainParams:
    seed: int = 42
    train_ratio: float = 0.8
    periods: int = 5
    members: dict[str, dict] = field(default_factory=lambda: dict(DEFAULT_MEMBERS))
    max_rounds: int = 1000
    calibrate: bool = True
    calibration_mode: str = "prefit"
    drift_learner: str = "boost"
    drift_rounds: int = 100
    drift_holdout: float = 0.2
    drift_threshold: float = 0.6
    drift_exclude: tuple[str, ...] | None = None
    parallelism: int = 1

    def __post_init__(self) -> None:
        _unit("train_ratio", self.train_ratio)
        _unit("drift_holdout", self.drift_holdout)
        if self.periods < 1:
            raise ValueError("periods must be at least 1")
        if self.calibration_mode not in ("prefit", "crossfit"):
            raise ValueError(f"unknown calibration mode: {self.calibration_mode}")
        if self.parallelism < 1:
            raise ValueError("parallelism must be at least 1")


@dataclass(frozen=True)
class EvalParams:
    bins: int = 10
    threshold: float = 0.5
    cost_fp: float = 1.0
    cost_fn: float = 10.0
    targets: dict[str, tuple[float, str]] = field(
        default_factory=lambda: dict(DEFAULT_TARGETS)
    )

    def __post_init__(self) -> None:
        if self.bins < 1:
            raise ValueError("bins must be at least 1")
        for name, (_, direction) in self.targets.items():
            if direction not in ("higher", "lower"):
                raise ValueError(f"target {name}: direction must be higher or lower")
