"""The left join of transactions with their optional identity rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_identity(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left outer join on ``key``. Repeated keys multiply; a name on both sides gets the
    suffixes. Spark picks broadcast or sort-merge from the sizes it sees at run time and
    splits skewed keys, so no hint is given."""
    shared = (set(left.columns) & set(right.columns)) - {key}
    a = left.select(*[F.col(c).alias(c + suffixes[0]) if c in shared else F.col(c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + suffixes[1]) if c in shared else F.col(c) for c in right.columns])
    return a.join(b, key, "left")


def stack_domains(source: DataFrame, target: DataFrame, reserved: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Union of the feature columns of both tables with ``domain`` 0 for source, 1 for
    target. A source feature the target lacks is an error, as it would have no values."""
    features = [c for c in source.columns if c not in reserved or c in keep]
    missing = [c for c in features if c not in target.columns]
    if missing:
        raise ValueError(f"target lacks columns {missing}")
    return (
        source.select(*features)
        .withColumn("domain", F.lit(0))
        .unionByName(target.select(*features).withColumn("domain", F.lit(1)))
    )


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both tables, in the order of the first."""
    return [c for c in a.columns if c in set(b.columns)]
