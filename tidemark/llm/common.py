"""What the operators share: reading a table, shared scratch tables, row identity."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import ensure_checkpoint_dir, scratch_path

#: A side of a join is broadcast only when its counted size stays below this many bytes.
BROADCAST_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; NULL counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a short lineage that
    survives lost executors, and a columnar table for narrow rereads."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast only for a side whose counted size is small; else leave the join to
    Spark, which shuffles it and splits skewed partitions."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_keeping(
    rows: DataFrame,
    kept: Sequence[str],
    work: Callable[[pd.DataFrame], Mapping | tuple[Sequence[int], Mapping]],
    made: str,
) -> DataFrame:
    """A narrow map whose ``kept`` columns stay in Arrow, so that a key of any type comes out
    as it went in (pandas would turn a long beside NULL into a double). ``work`` gets the other
    columns of a batch and gives those of the DDL ``made``, by name: a value for each row, or
    rows at the positions it names."""
    kinds = StructType.fromDDL(made)
    schema = StructType([rows.schema[k] for k in kept] + kinds.fields)
    arrow = to_arrow_schema(kinds)
    free = [c for c in rows.columns if c not in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch.select(free).to_pandas())
            held = [batch.column(k) for k in kept]
            if isinstance(out, tuple):
                at, out = out
                held = [c.take(pa.array(at, pa.int64())) for c in held]
            new = [pa.array(out[f.name], type=f.type, from_pandas=True) for f in arrow]
            yield pa.RecordBatch.from_arrays([*held, *new], names=[*kept, *arrow.names])

    return rows.mapInArrow(run, schema)
