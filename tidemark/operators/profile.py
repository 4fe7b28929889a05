"""Table profiles: one scan with partial aggregation, however many columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bins import left_closed_bin, right_closed_bin
from tidemark.functions.columns import hour_of_day, safe_div
from tidemark.operators.quantiles import exact_quantiles
from tidemark.params import Roles


def corrected_skewness(c: Column) -> Column:
    """Sample skewness with the small-sample correction; NULL below three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def schema_profile(df: DataFrame, roles: Roles) -> DataFrame:
    """Long list of feature columns with their kind, and table-level counts alongside."""
    numeric, categorical = roles.numeric(df), roles.categorical(df)
    features = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("kind")) for c in numeric],
        *[F.struct(F.lit(c).alias("column"), F.lit("categorical").alias("kind")) for c in categorical],
    )
    rate = F.avg(F.col(roles.label).cast("double")) if roles.label in df.columns else F.lit(None).cast("double")
    totals = df.agg(F.count(F.lit(1)).alias("n_samples"), rate.alias("fraud_rate"))
    return totals.select(
        F.explode(features).alias("f"), "n_samples", F.lit(len(numeric) + len(categorical)).cast("bigint").alias("n_features"), "fraud_rate"
    ).select("f.column", "f.kind", "n_samples", "n_features", "fraud_rate")


def _wide_to_long(df: DataFrame, columns: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """Aggregate every column in one pass, then turn the single row into one per column."""
    aggs = [make(F.col(c).cast("double")).alias(f"s{i}_{s}") for i, c in enumerate(columns) for s, make in stats.items()]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"s{i}_{s}").alias(s) for s in stats])
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str],
    approx: bool = False,
    quartiles: dict[str, list[float | None]] | None = None,
) -> DataFrame:
    """Mean, sample deviation, range and quartiles per column. Quartiles are exact and
    interpolated, or taken as given (lower and upper per column); ``approx`` takes them
    from a sketch in the same scan."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if approx:
        stats |= {
            "q25": lambda c: F.percentile_approx(c, F.lit(0.25)),
            "q75": lambda c: F.percentile_approx(c, F.lit(0.75)),
        }
        return _wide_to_long(df, columns, stats)
    if quartiles is None:
        quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75])
    at = {p: F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(quartiles[c][i]).cast("double"))]) for i, p in enumerate(("q25", "q75"))}
    return _wide_to_long(df, columns, stats).withColumns({p: at[p][F.col("feature")] for p in at})


def drift_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _wide_to_long(df, columns, {"mean": F.avg, "std": F.stddev_samp, "skew": corrected_skewness})


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (feature, value), NULLs left out; one shuffle of partial counts."""
    long = df.select(*columns).unpivot([], list(columns), "feature", "value")
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def category_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Relative frequency per value. The totals have one row per column, so they are
    broadcast instead of pulling a column's values into one window task."""
    counts = category_counts(df, columns)
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", "value", safe_div("n", "total").alias("frequency")
    )


def top_categories(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column. The rank filter lets Spark keep only k
    rows per feature and partition before the shuffle."""
    best = Window.partitionBy("feature").orderBy(F.col("frequency").desc(), F.col("value"))
    ranked = category_frequencies(df, columns).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k)


def range_of(df: DataFrame, column: str) -> tuple[Column, Column]:
    """Minimum and maximum as a scalar subquery: evaluated once, used as a constant."""
    c = F.col(column).cast("double")
    stats = df.agg(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias("range")).scalar()
    return stats.getField("low"), stats.getField("high")


def with_time_bin(df: DataFrame, time: str, bins: int = 10, name: str = "time_period") -> DataFrame:
    low, high = range_of(df, time)
    return df.withColumn(name, right_closed_bin(time, low, high, bins))


def period_summary(df: DataFrame, roles: Roles, period: str = "period") -> DataFrame:
    return df.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(roles.label).cast("double")).alias("fraud_rate"),
        F.avg(roles.amount).alias("mean_amount"),
        F.min(roles.time).alias("time_min"),
        F.max(roles.time).alias("time_max"),
    )


def rate_by_time_bin(df: DataFrame, time: str, label: str, bins: int = 20) -> DataFrame:
    """Volume and label rate per equal-width time bin; empty bins appear with 0 rows."""
    filled = (
        with_time_bin(df.select(time, label), time, bins, "bin")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("fraud_rate"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(filled), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rate_by_hour(df: DataFrame, time: str, label: str) -> DataFrame:
    return df.groupBy(hour_of_day(time).alias("hour")).agg(
        F.avg(F.col(label).cast("double")).alias("fraud_rate")
    )


def histogram(df: DataFrame, column: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Counts and density per equal-width bin over the column's range, per ``by`` group."""
    low, high = range_of(df, column)
    spread = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))  # constant column
    low, high = low - spread, high + spread
    counts = (
        df.where(F.col(column).isNotNull())
        .select(*by, left_closed_bin(column, low, high, bins).alias("bin"), low.alias("_low"), high.alias("_high"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    )
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    joined = counts.join(totals, list(by)) if by else counts.withColumn("_total", totals.select("_total").scalar())
    return joined.select(
        *by,
        "bin",
        (F.col("_low") + F.col("bin") * width).alias("bin_low"),
        (F.col("_low") + (F.col("bin") + 1) * width).alias("bin_high"),
        "n",
        safe_div("n", F.col("_total") * width).alias("density"),
    )


def correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with ``target``."""
    rows = F.array(*[F.struct(F.lit(c).alias("member"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(columns)])
    return df.agg(*[F.corr(c, target).alias(f"c{i}") for i, c in enumerate(columns)]).select(
        F.explode(rows).alias("r")
    ).select("r.*")


def member_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _wide_to_long(df, columns, {"mean": F.avg, "std": F.stddev_pop})
