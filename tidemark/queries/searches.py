"""Hyper-parameter search over time-ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.search import Search, grid, time_folds
from tidemark.queries.base import TX, query, rounded, transactions
from tidemark.queries.drift_models import ROLES, engineered

FOLDS = 3


@query(
    "ext5_time_folds",
    f"""WITH {TX}, r AS (SELECT *, least((row_number() OVER (ORDER BY "TransactionDT", "TransactionID") - 1)
  // (count(*) OVER () // {FOLDS + 1}), {FOLDS}) AS fold FROM tx)
SELECT f AS fold, count(*) FILTER (WHERE fold < f) AS learned, count(*) FILTER (WHERE fold = f) AS judged,
sum("isFraud") FILTER (WHERE fold < f)::BIGINT AS learned_positive, sum("isFraud") FILTER (WHERE fold = f)::BIGINT AS judged_positive
FROM r, (SELECT unnest([1, 2, 3]) AS f) GROUP BY f""",
)
def _(spark, d):
    """Rows that each fold learns from and is judged on."""
    rows = time_folds(transactions(spark, d), ROLES.time, ROLES.key, FOLDS)
    f, own, y = F.col("f"), F.col("fold"), F.col(ROLES.label)
    counted = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"))
    spread = counted.withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(FOLDS))))

    def total(column, when):
        return F.sum(F.when(when, F.col(column))).cast("long")

    return spread.groupBy(f.alias("fold")).agg(
        total("n", own < f).alias("learned"),
        total("n", own == f).alias("judged"),
        total("y", own < f).alias("learned_positive"),
        total("y", own == f).alias("judged_positive"),
    )


@query("ext5_hyperparameter_search")
def _(spark, d):
    """Four settings of logistic regression: 10 iterations, and 50 for the better half."""
    rows, columns = engineered(spark, d)
    folds = time_folds(rows.drop("period"), ROLES.time, ROLES.key, 2)
    values = {"regParam": [0.1, 0.001], "elasticNetParam": [0.0, 0.5]}
    search = Search(grid(values), "logreg", budgets=(10, 50), keep=0.5).fit(folds, columns, ROLES.label)
    return rounded(search.table(spark), ["mean_auc"])
