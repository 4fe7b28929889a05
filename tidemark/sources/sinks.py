"""Metric tables, reports and scored output. Only metric rows ever reach the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructField

METRIC_SCHEMA = "run_id string, scope string, metric string, value double"


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def wide_to_metrics(df: DataFrame, scope: str, key: str | None = None, prefix: str = "") -> DataFrame:
    """(scope, metric, value) rows from a frame of metric columns. With ``key`` each row's
    metrics are named ``<prefix><key>_<column>``, such as ``period_3_auc``."""

    def is_metric(f: StructField) -> bool:
        return isinstance(f.dataType, (NumericType, BooleanType)) and f.name != key

    names = [f.name for f in df.schema.fields if is_metric(f)]
    lead = F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit("_")) if key else F.lit(prefix)
    rows = F.array(
        *[
            F.struct(F.concat(lead, F.lit(n)).alias("metric"), F.col(n).cast("double").alias("value"))
            for n in names
        ]
    )
    return df.select(F.lit(scope).alias("scope"), F.explode(rows).alias("m")).select("scope", "m.*")


def dict_to_metrics(spark: SparkSession, values: dict[str, float], scope: str) -> DataFrame:
    return spark.createDataFrame(
        [(scope, k, float(v)) for k, v in values.items() if v is not None],
        "scope string, metric string, value double",
    )


def union_metrics(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Append one run to the metrics table. The rows are few, hence one file per run."""
    metrics.select(F.lit(run_id).alias("run_id"), "scope", "metric", "value").coalesce(1).write.mode(
        "append"
    ).partitionBy("run_id").parquet(path)


def read_metrics(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.schema(METRIC_SCHEMA).parquet(path)
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_json(spark: SparkSession, body: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(body, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def publish(spark: SparkSession, body: dict, path: str) -> None:
    """Put ``body`` at ``path`` as one JSON file in one step: written beside it first, then
    renamed over it. A reader finds the old file or the new one, never a part."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(beside)
    try:
        out.write(bytearray(json.dumps(body, default=str).encode()))
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    files = target.getFileSystem(conf)
    hadoop.FileContext.getFileContext(files.makeQualified(target).toUri(), conf).rename(
        files.makeQualified(beside), files.makeQualified(target), overwrite
    )


def check_targets(metrics: DataFrame, targets: dict[str, tuple[float, str]]) -> DataFrame:
    """(metric, target, direction, value, met). A metric that was not computed counts as
    not met, whichever the direction."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(
        [(m, float(t), d) for m, (t, d) in targets.items()], "metric string, target double, direction string"
    )
    met = F.when(F.col("direction") == "lower", F.col("value") <= F.col("target")).otherwise(
        F.col("value") >= F.col("target")
    )
    return (
        F.broadcast(wanted)
        .join(metrics.select("metric", "value"), "metric", "left")
        .withColumn("met", F.coalesce(met, F.lit(False)))
    )


# Report sections and the metric name parts that belong to each.
REPORT_SECTIONS = {
    "Ranking and thresholds": ("auroc", "auprc", "precision", "recall", "specificity", "f1", "accuracy", "log_loss", "true_", "false_"),
    "Calibration": ("calibration_",),
    "Drift detection": ("drift_",),
    "Temporal stability": ("temporal_", "stability_", "consistency_", "period_"),
    "Business": ("cost", "fraud_catch", "false_alarm", "_at_"),
}


def report_lines(rows: Sequence[tuple[str, float]], title: str) -> list[str]:
    """Sectioned text of at most a few hundred metrics; each metric in one section."""
    left = dict(rows)
    lines = [title, "=" * len(title)]
    order = ["Business", *[s for s in REPORT_SECTIONS if s != "Business"]]
    placed: dict[str, list[str]] = {s: [] for s in REPORT_SECTIONS}
    for section in order:
        parts = REPORT_SECTIONS[section]
        for name in [n for n in left if any(p in n for p in parts)]:
            placed[section].append(f"  {name}: {left.pop(name):.6f}")
    for section in REPORT_SECTIONS:
        if placed[section]:
            lines += ["", section, "-" * len(section), *sorted(placed[section])]
    if left:
        lines += ["", "Other", "-----", *sorted(f"  {n}: {v:.6f}" for n, v in left.items())]
    return lines


def write_report(metrics: DataFrame, path: str, title: str = "Evaluation report") -> str:
    """JSON rows and a text summary side by side; returns the text."""
    rows = [(r["metric"], r["value"]) for r in metrics.select("metric", "value").collect() if r["value"] is not None]
    text = "\n".join(report_lines(rows, title))
    write_metrics_json(metrics, f"{path}/metrics")
    spark = metrics.sparkSession
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/summary")
    return text


def write_scores(scored: DataFrame, path: str, key: str, partition: str | None = None) -> None:
    """(key, prob, pred) per input row, optionally partitioned by period."""
    columns = [key, "prob", "pred", *([partition] if partition else [])]
    writer = scored.select(*columns).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


