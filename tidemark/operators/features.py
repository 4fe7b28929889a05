"""Feature engineering: impute, derive, encode, scale.

``FeatureEngineer`` is an Estimator and ``FeatureModel`` its Model; both are stages of a Spark
ML ``Pipeline`` and are saved and loaded with it. What is learned stays small (medians, modes, means) except the
category codes, which stay a table and are joined.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    day_of_week,
    hour_of_day,
    is_night,
    is_weekend,
    nan_to_null,
    null_if_nan,
    plus_one_ratio,
    row_mean,
    row_sum,
    standardise,
    with_row_std,
    zscore,
)
from tidemark.operators.order import row_index
from tidemark.operators.profile import category_counts, category_frequencies, numeric_profile
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.velocity import HOT_ROWS, with_velocity
from tidemark.params import Roles, family
from tidemark.session import cut_lineage
from tidemark.sources.readers import read_optional

#: A column's code table is broadcast only below this many bytes.
BROADCAST_BYTES = 8 << 20


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    found = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5])
    return {c: v[0] for c, v in found.items()}


def modes_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column; the smallest value wins a tie."""
    best = F.min_by("value", F.struct((-F.col("n")).alias("rank"), F.col("value").alias("tie")))
    return category_counts(df, columns).groupBy("feature").agg(best.alias("mode"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    if not columns:
        return {}
    found = {r["feature"]: r["mode"] for r in modes_table(df, columns).collect()}
    return {c: found.get(c) for c in columns}


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): sorted distinct values numbered from 0 per feature. The
    numbering is the distributed position, so a column may have any number of values."""
    long = df.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) for c in columns])
    values = long.unpivot([], list(columns), "feature", "value").distinct()
    numbered = row_index(values, ["value"], ["feature"], "code")
    return numbered.withColumn("code", F.col("code") - 1)


def unknown_categories(df: DataFrame, columns: Sequence[str], codes: DataFrame) -> DataFrame:
    """Distinct (feature, value) pairs of ``df`` that the code table does not have."""
    long = df.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) for c in columns])
    seen = long.unpivot([], list(columns), "feature", "value").distinct()
    return seen.join(codes, ["feature", "value"], "left_anti")


def impute(df: DataFrame, numeric: dict[str, float | None], categorical: dict[str, str | None]) -> DataFrame:
    """Fill of NULL and NaN with fitted medians and modes; columns fitted as all-NULL are left
    alone."""
    fills = {
        c: F.coalesce(null_if_nan(F.col(c).cast("double")), F.lit(float(v)))
        for c, v in numeric.items()
        if v is not None and c in df.columns
    }
    fills |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in categorical.items() if v is not None and c in df.columns}
    return df.withColumns(fills) if fills else df


def amount_moments(df: DataFrame, amount: str) -> tuple[Column, Column]:
    """Mean and sample deviation of this very table, as a scalar subquery."""
    c = F.col(amount).cast("double")
    one = df.agg(F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias("m")).scalar()
    return one.getField("mean"), one.getField("std")


def engineer(
    df: DataFrame,
    roles: Roles,
    amount_stats: tuple[float, float] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the derived columns whose inputs are present. Without ``amount_stats`` the
    z-score uses the moments of the table at hand."""
    has = set(df.columns)
    new: dict[str, Column] = {}
    wide: dict[str, list[str]] = {}
    if roles.amount in has:
        if amount_stats is None:
            mean, std = amount_moments(df, roles.amount)
        else:
            mean, std = (F.lit(float(x)) for x in amount_stats)
        new[f"{roles.amount}_log"] = F.log1p(roles.amount)
        new[f"{roles.amount}_zscore"] = zscore(roles.amount, mean, std)
    if roles.time in has:
        hour, dow = hour_of_day(roles.time), day_of_week(roles.time)
        new |= {"hour": hour, "day_of_week": dow, "is_weekend": is_weekend(dow), "is_night": is_night(hour)}
    if {roles.card, roles.card_secondary} <= has:
        new[f"{roles.card}_{roles.card_secondary}_ratio"] = plus_one_ratio(roles.card, roles.card_secondary)
    near, far = roles.distances
    if {near, far} <= has:
        new["dist_total"] = F.col(near) + F.col(far)
        new["dist_ratio"] = plus_one_ratio(near, far)
    for prefix, least, second in (("C", 2, "mean"), ("D", 2, "mean"), ("V", 3, "std")):
        cols = family(df, prefix)
        if len(cols) >= least:
            new[f"{prefix}_sum"] = row_sum(cols)
            if second == "mean":
                new[f"{prefix}_mean"] = row_mean(cols)
            else:
                wide[f"{prefix}_std"] = cols
    out = df.withColumns(new) if new else df
    for name, cols in wide.items():
        out = with_row_std(out, cols, name)
    if {roles.card, roles.time, roles.key} <= has:
        out = with_velocity(out, roles.card, roles.time, roles.key, hot_rows=hot_rows)
    return out


def code_bytes(codes: DataFrame) -> dict[str, int]:
    """Bytes of each column's code table: values, and 16 for each row."""
    sizes = codes.groupBy("feature").agg(F.sum(F.octet_length("value") + 16).alias("bytes"))
    return {r["feature"]: r["bytes"] for r in sizes.collect()}


def encode(
    df: DataFrame, columns: Sequence[str], codes: DataFrame, sizes: dict[str, int], fallback: dict[str, int]
) -> DataFrame:
    """Replace each category by its code. A column's table is broadcast only while its own
    counted bytes (``sizes``) allow; beyond that Spark joins it by shuffle and splits hot
    values."""
    out = df
    for c in columns:
        table = codes.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        if sizes.get(c, 0) <= BROADCAST_BYTES:
            table = F.broadcast(table)
        joined = out.withColumn("_key", F.coalesce(F.col(c), F.lit("nan"))).join(
            table, F.col("_key") == F.col("_v"), "left"
        )
        out = joined.withColumn(c, F.coalesce(F.col("_code"), F.lit(fallback.get(c, 0))).cast("int")).drop(
            "_key", "_v", "_code"
        )
    return out


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column, one row, one scan."""
    return df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"std_{i}") for i, c in enumerate(columns)],
    )


def scale(df: DataFrame, stats: dict[str, tuple[float, float]], null_fill: float | None = 0.0) -> DataFrame:
    """Standardise fitted columns; a NULL is read as ``null_fill`` before scaling (a
    card's first row has no velocity and learners take no NULLs), or kept if None."""
    exprs = {}
    for c, (mean, std) in stats.items():
        x = F.col(c).cast("double")
        exprs[c] = standardise(x if null_fill is None else F.coalesce(x, F.lit(float(null_fill))), mean, std)
    return df.withColumns(exprs)


class FeatureEngineer(Estimator, MLWritable, MLReadable):
    """Learns the feature state. ``zscore_stats``: "fitted" scores new rows against the
    training amounts, "batch" against their own table. ``unseen``: code of an unknown
    category, "first" in sort order or the "mode" of the training rows."""

    def __init__(
        self,
        roles: Roles = Roles(),
        zscore_stats: str = "fitted",
        unseen: str = "first",
        null_fill: float | None = 0.0,
        keep_profile: bool = True,
        hot_rows: int = HOT_ROWS,
    ) -> None:
        super().__init__()
        if zscore_stats not in ("fitted", "batch") or unseen not in ("first", "mode"):
            raise ValueError("zscore_stats is fitted|batch, unseen is first|mode")
        self.roles = roles
        self.options = {
            "zscore_stats": zscore_stats,
            "unseen": unseen,
            "null_fill": null_fill,
            "hot_rows": hot_rows,
        }
        self.keep_profile = keep_profile

    def write(self) -> MLWriter:
        return _Writer(self)

    def _write(self, path: str) -> None:
        _write_state({"roles": self.roles.__dict__, "options": self.options, "keep_profile": self.keep_profile}, path)

    @classmethod
    def _read(cls, spark: SparkSession, path: str) -> FeatureEngineer:
        body = _read_state(spark, path)
        return cls(_roles(body["roles"]), keep_profile=body["keep_profile"], **body["options"])

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _fit(self, df: DataFrame) -> FeatureModel:
        roles, df = self.roles, nan_to_null(df)
        numeric, categorical = roles.numeric(df), roles.categorical(df)
        # Medians to impute with and quartiles of the profile from the same scans.
        probs = [0.25, 0.5, 0.75] if self.keep_profile else [0.5]
        quantiles = exact_quantiles(df, {c: F.col(c) for c in numeric}, probs)
        state = {
            "medians": {c: q[len(q) // 2] for c, q in quantiles.items()},
            "modes": modes(df, categorical),
            "amount": None,
            "scaler": {},
            "fallback": {},
            "code_bytes": {},
        }
        filled = impute(df, state["medians"], state["modes"])
        if roles.amount in df.columns:
            row = filled.agg(F.avg(roles.amount), F.stddev_samp(roles.amount)).first()
            state["amount"] = [row[0], row[1] or 0.0]
        codes = None
        if categorical:
            codes = cut_lineage(category_codes(filled, categorical))
            state["code_bytes"] = code_bytes(codes)
            if self.options["unseen"] == "mode":
                wanted = df.sparkSession.createDataFrame(
                    [(c, v) for c, v in state["modes"].items() if v is not None], "feature string, value string"
                )
                hits = codes.join(F.broadcast(wanted), ["feature", "value"]).collect()
                state["fallback"] = {r["feature"]: int(r["code"]) for r in hits}
        profile = None
        if self.keep_profile:
            quartiles = {c: [q[0], q[-1]] for c, q in quantiles.items()}
            profile = (
                cut_lineage(numeric_profile(df, numeric, quartiles=quartiles)) if numeric else None,
                cut_lineage(category_frequencies(df, categorical)) if categorical else None,
            )
        model = FeatureModel(roles, self.options, state, codes, profile)
        derived = model.derive(df, batch_amount=False)
        columns = roles.numeric(derived)
        row = scaler_stats(derived, columns).first()
        state["scaler"] = {
            c: (row[f"mean_{i}"] or 0.0, row[f"std_{i}"] or 0.0) for i, c in enumerate(columns)
        }
        return model


class FeatureModel(Model, MLWritable, MLReadable):
    def __init__(self, roles: Roles, options: dict, state: dict, codes: DataFrame | None, profile=None) -> None:
        super().__init__()
        self.roles, self.options, self.state = roles, options, state
        self.codes, self.profile = codes, profile

    @property
    def feature_columns(self) -> list[str]:
        return list(self.state["scaler"])

    def derive(self, df: DataFrame, batch_amount: bool | None = None) -> DataFrame:
        """Imputed, derived and encoded columns before scaling."""
        batch = self.options["zscore_stats"] == "batch" if batch_amount is None else batch_amount
        filled = impute(df, self.state["medians"], self.state["modes"])
        amount = None if batch or self.state["amount"] is None else tuple(self.state["amount"])
        out = engineer(filled, self.roles, amount, self.options["hot_rows"])
        if self.codes is not None:
            cols = [c for c in self.state["modes"] if c in df.columns]
            out = encode(out, cols, self.codes, self.state["code_bytes"], self.state["fallback"])
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        return scale(self.derive(df), self.state["scaler"], self.options["null_fill"])

    def unknown(self, df: DataFrame) -> DataFrame:
        """Report of category values never seen in training."""
        cols = [c for c in self.state["modes"] if c in df.columns]
        return unknown_categories(impute(df, {}, self.state["modes"]), cols, self.codes)

    def write(self) -> MLWriter:
        return _Writer(self)

    def save(self, path: str) -> None:
        self.write().overwrite().save(path)

    def _write(self, path: str) -> None:
        body = {"roles": self.roles.__dict__, "options": self.options, "state": self.state}
        _write_state(body, path)
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        for name, table in zip(("numeric", "categorical"), self.profile or (None, None)):
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/profile/{name}")

    @classmethod
    def _read(cls, spark: SparkSession, path: str) -> FeatureModel:
        body = _read_state(spark, path)
        state = body["state"]
        state["scaler"] = {c: tuple(v) for c, v in state["scaler"].items()}
        codes = spark.read.parquet(f"{path}/codes") if state["modes"] else None
        profile = tuple(read_optional(spark, f"{path}/profile/{n}", "parquet") for n in ("numeric", "categorical"))
        return cls(_roles(body["roles"]), body["options"], state, codes, profile if any(t is not None for t in profile) else None)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


# --------------------------------------------------------------------------- persistence


def _write_state(body: dict, path: str) -> None:
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def _read_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/state").first()["value"])


def _roles(body: dict) -> Roles:
    return Roles(**{k: tuple(v) if isinstance(v, list) else v for k, v in body.items()})


class _Writer(MLWriter):
    """Spark ML's metadata, by which a pipeline finds the class, beside the stage's own files."""

    def __init__(self, stage: FeatureEngineer | FeatureModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:  # noqa: N802  Spark ML's name
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage._write(path)


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> FeatureEngineer | FeatureModel:
        out = self.kind._read(self.sparkSession, path)
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out._resetUid(metadata["uid"])
        return out
