"""Scalar and row-wise column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
HOUR = 3_600


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Double division that is NULL on a zero divisor (ANSI mode raises otherwise)."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def hour_of_day(seconds: Column | str) -> Column:
    s = as_column(seconds)
    return F.floor(F.pmod(s, F.lit(DAY)) / F.lit(HOUR)).cast("int")


def day_of_week(seconds: Column | str) -> Column:
    s = as_column(seconds)
    return F.pmod(F.floor(s / F.lit(DAY)), F.lit(7)).cast("int")


def is_weekend(dow: Column | str) -> Column:
    return as_column(dow).isin(5, 6).cast("int")


def is_night(hour: Column | str) -> Column:
    """23:00 to 05:59."""
    return as_column(hour).isin(23, 0, 1, 2, 3, 4, 5).cast("int")


def zscore(x: Column | str, mean: Column, std: Column) -> Column:
    return safe_div(as_column(x) - mean, std)


def standardise(x: Column | str, mean: float, std: float) -> Column:
    """Fitted mean and population deviation; a constant column keeps deviation 1."""
    return (as_column(x).cast("double") - F.lit(float(mean))) / F.lit(float(std) or 1.0)


def plus_one_ratio(a: Column | str, b: Column | str) -> Column:
    return safe_div(a, as_column(b) + F.lit(1))


def null_if_nan(x: Column | str) -> Column:
    c = as_column(x)
    return F.when(~F.isnan(c), c)


def _balanced(terms: Sequence[Column]) -> Column:
    """The sum of many terms as a balanced tree: a family may have hundreds of columns, whose
    chain of additions would be as deep."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2 :]
    return terms[0]


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def row_sum(cols: Sequence[str]) -> Column:
    """Sum over columns of one row; NULLs are skipped, an all-NULL row gives 0."""
    return _balanced([F.coalesce(_double(c), F.lit(0.0)) for c in cols])


def row_count(cols: Sequence[str]) -> Column:
    """Columns of one row that are not NULL."""
    return _balanced([F.col(c).isNotNull().cast("double") for c in cols])


def row_mean(cols: Sequence[str]) -> Column:
    return safe_div(row_sum(cols), row_count(cols))


def with_row_std(df, cols: Sequence[str], name: str):
    """Add the sample deviation over columns of one row, NULL for fewer than two values. Mean
    and count are a projection of their own, which every squared distance then refers to."""
    mean, n = f"_mean_{name}", f"_n_{name}"
    squares = [F.coalesce((_double(c) - F.col(mean)) * (_double(c) - F.col(mean)), F.lit(0.0)) for c in cols]
    std = F.when(F.col(n) >= 2, F.sqrt(safe_div(_balanced(squares), F.col(n) - 1)))
    return df.withColumns({mean: row_mean(cols), n: row_count(cols)}).withColumn(name, std).drop(mean, n)


def stable_hash(key: Column | str, seed: int = 0) -> Column:
    """32-bit number from md5, the same on every engine and under any partitioning."""
    text = F.concat(as_column(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def pick(threshold: float, prob: Column | str = "prob") -> Column:
    """Strict threshold: a probability equal to it is class 0."""
    return (as_column(prob) > F.lit(float(threshold))).cast("int")


def risk_score(
    amount: Column | str,
    hour: Column | str,
    device: Column | str,
    distance: Column | str,
    time: Column | str,
    amount_q90: Column,
    distance_q80: Column,
) -> Column:
    """Additive rule score clipped to [0, 1]."""
    # Base rate and increments of the rule.
    base, large, night, mobile, far, drift = 0.035, 0.02, 0.01, 0.015, 0.01, 0.01

    def bump(condition: Column, by: float) -> Column:
        return F.when(condition, F.lit(by)).otherwise(F.lit(0.0))

    h = as_column(hour)
    score = (
        F.lit(base)
        + bump(as_column(amount) > amount_q90, large)
        + bump((h < 6) | (h > 22), night)
        + bump(as_column(device) == F.lit("mobile"), mobile)
        + bump(as_column(distance) > distance_q80, far)
        + F.lit(drift) * (as_column(time) / F.lit(100.0))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def nan_to_null(df):
    """``df`` with NaN read as missing in every float and double column."""
    new = {c: null_if_nan(F.col(f"`{c}`")) for c, t in df.dtypes if t in ("float", "double")}
    return df.withColumns(new) if new else df
