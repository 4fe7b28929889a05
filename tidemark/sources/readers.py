"""Readers for transaction and identity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidemark.functions.columns import day_of_week, hour_of_day, null_if_nan
from tidemark.operators.joins import left_join_identity
from tidemark.operators.profile import with_time_bin
from tidemark.params import Roles


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    nan_as_null: bool | None = None,
) -> DataFrame:
    """One table. CSV has a header; give a schema to avoid the inference scan.

    Every later operator knows one notion of missing, so NaN becomes NULL here. Parquet
    stores NULL as such and is left as it is by default: a wrapped column would keep
    filters on it from reaching the scan.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.load(path)
    if nan_as_null is None:
        nan_as_null = fmt != "parquet"
    floats = [f.name for f in df.schema.fields if nan_as_null and isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: null_if_nan(c) for c in floats}) if floats else df


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet", **kwargs) -> DataFrame | None:
    """The table, or None when nothing lies at ``path``; other errors are raised."""
    try:
        return read_table(spark, path, fmt, **kwargs)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def with_time_parts(df: DataFrame, time: str = "TransactionDT") -> DataFrame:
    """Hour and day of week from seconds, unless the table brings its own hour."""
    if "hour" in df.columns or time not in df.columns:
        return df
    return df.withColumns({"hour": hour_of_day(time), "day_of_week": day_of_week(time)})


def read_transactions(
    spark: SparkSession,
    directory: str,
    name: str,
    fmt: str = "csv",
    roles: Roles = Roles(),
    schemas: dict[str, StructType] | None = None,
) -> DataFrame:
    """``<name>_transaction`` left-joined with ``<name>_identity`` where that exists, with
    time parts and a ten-bin time period. A missing transaction table is an error."""
    suffix = f".{fmt}" if fmt == "csv" else ""
    schemas = schemas or {}
    df = read_table(spark, f"{directory}/{name}_transaction{suffix}", fmt, schemas.get("transaction"))
    identity = read_optional(spark, f"{directory}/{name}_identity{suffix}", fmt, schema=schemas.get("identity"))
    if identity is not None:
        df = left_join_identity(df, identity, roles.key)
    df = with_time_parts(df, roles.time)
    return with_time_bin(df, roles.time) if roles.time in df.columns else df


def load_data(spark: SparkSession, directory: str, **kwargs) -> tuple[DataFrame, DataFrame]:
    return (
        read_transactions(spark, directory, "train", **kwargs),
        read_transactions(spark, directory, "test", **kwargs),
    )


def select_features(df: DataFrame, roles: Roles, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*extra, *roles.features(df))


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a zoneless timestamp, as double with microseconds. Built from
    its fields, so the session's time zone plays no part."""
    t = F.col(ts)
    whole = F.unix_date(t.cast("date")).cast("bigint") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    micros = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return (whole * 1_000_000 + micros).cast("double") / F.lit(1e6)
