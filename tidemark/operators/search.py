"""Hyper-parameter search by successive halving over time-ordered folds.

All candidates read one table of engineered rows, cut into periods by time. Fold ``f`` learns
from every period before ``f`` and is judged on period ``f``, so no candidate sees the future.
A rung fits each remaining candidate on all folds with the rung's budget (rounds of boosting);
the best share goes on to the next rung. Scores of a rung are collapsed to score counts as they
are written, and one ranking pass over them judges all candidates and folds. Only metric
rows, one for each candidate and fold, reach the driver.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.learners import assemble, make_learner, with_probability
from tidemark.operators.ranking import point_metrics, score_points
from tidemark.operators.splits import drift_periods
from tidemark.session import drop_table, write_table

#: The setting of each kind of learner that a rung's budget sets.
BUDGET = {"boost": "rounds", "gbt": "maxIter", "rf": "numTrees", "logreg": "maxIter"}


def grid(values: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the given values, in the order of the lists."""
    return [dict(zip(values, c)) for c in itertools.product(*values.values())]


def time_folds(df: DataFrame, time: str, key: str, folds: int) -> DataFrame:
    """Add ``fold``: 0 is only learned from, 1 to ``folds`` are judged, each on what lies before."""
    if folds < 1:
        raise ValueError("folds must be at least 1")
    return drift_periods(df, time, key, folds + 1).withColumnRenamed("period", "fold")


def survivors(scores: Mapping[int, float | None], keep: float) -> list[int]:
    """Candidates that go on: the best share of at least one, ties by position; a candidate
    without a score (no fold with both classes) comes last."""
    ranked = sorted(scores, key=lambda c: (scores[c] is None, -(scores[c] or 0.0), c))
    return ranked[: max(1, math.ceil(len(ranked) * keep))]


@dataclass
class Search:
    """Candidates of one kind of learner; ``budgets`` are the rounds of the rungs, ascending.
    One budget is an exhaustive search."""

    candidates: Sequence[dict]
    kind: str = "boost"
    budgets: Sequence[int] = (30, 90, 270)
    keep: float = 1 / 3
    seed: int = 42
    trials: list[tuple] = field(default_factory=list)
    best: dict | None = None

    def __post_init__(self) -> None:
        if not self.candidates:
            raise ValueError("no candidates")
        if list(self.budgets) != sorted(set(self.budgets)) or not self.budgets:
            raise ValueError("budgets must ascend")
        if not 0.0 < self.keep <= 1.0:
            raise ValueError(f"keep must lie above 0 and not above 1, got {self.keep}")

    def fit(self, rows: DataFrame, features: Sequence[str], label: str, fold: str = "fold") -> Search:
        """Search over ``rows`` with the column ``fold``; pass rows that are cheap to scan."""
        self.trials, self.best = [], None
        spark = rows.sparkSession
        table = write_table(
            assemble(rows.where(F.col(label).isNotNull()), features).select(
                F.col(label).alias("label"), F.col(fold).cast("int").alias("fold"), "features"
            ),
            "search-rows",
        )
        folds = sorted(r[0] for r in table.select("fold").distinct().collect() if r[0])
        if not folds:
            raise ValueError("a search needs two folds or more")
        alive = list(range(len(self.candidates)))
        for rung, budget in enumerate(self.budgets):
            found = self._judged(spark, table, alive, folds, budget)
            means = {c: sum(v) / len(v) if (v := found.get(c, [])) else None for c in alive}
            last = rung == len(self.budgets) - 1
            on = survivors(means, self.keep)
            order = survivors(means, 1.0)
            for place, c in enumerate(order, start=1):
                kept = c == order[0] if last else c in on
                params = json.dumps(self.candidates[c], sort_keys=True)
                self.trials.append((rung, budget, c, params, means[c], len(found.get(c, [])), place, kept))
            alive = sorted(on)
            self.best = self.candidates[order[0]]
        drop_table(table)
        return self

    def _judged(self, spark: SparkSession, table: DataFrame, alive: Sequence[int], folds: Sequence[int], budget: int) -> dict[int, list[float]]:
        """AUC of each fold by candidate."""
        found: dict[int, list[float]] = {}
        points = None
        written = []
        for c in alive:
            for f in folds:
                params = {**self.candidates[c], BUDGET[self.kind]: budget}
                learner = make_learner(self.kind, "label", self.seed, params)
                model = learner.fit(table.where(F.col("fold") < f).drop("fold"))
                scored = with_probability(table.where(F.col("fold") == f), model, "prob").select(
                    "label", "prob", F.lit(c).alias("candidate"), "fold"
                )
                written.append(write_table(score_points(scored, group=["candidate", "fold"]), "search-scores"))
                points = written[-1] if points is None else points.unionByName(written[-1])
        for row in point_metrics(points, ["candidate", "fold"]).orderBy("candidate", "fold").collect():
            found.setdefault(row["candidate"], []).append(row["auc"])
        for scores in written:
            drop_table(scores)
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """All trials: rung, budget, candidate, its settings, mean AUC over the folds with both
        classes, their number, place within the rung and whether the candidate went on."""
        schema = "rung int, budget int, candidate int, params string, mean_auc double, folds int, place int, kept boolean"
        return spark.createDataFrame(self.trials, schema)
