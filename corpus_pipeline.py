"""The cleaning pipeline over ``documents``: each stage is written as Parquet and read back
as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import queries as llm
from tidemark.llm.bpe import encode_decode
from tidemark.llm.common import read, written
from tidemark.llm.decontaminate import without_leaks
from tidemark.llm.quality import score, train
from tidemark.llm.secret_scan import redact
from tidemark.llm.simhash import keep_first

#: Stages on learned models, fingerprints and a tokenizer: SQL cannot express their rows.
ORACLE_SQL = None

#: Near-duplicates: words of a shingle and bits that linked fingerprints may differ in, as in
#: the operator's own query.
WIDTH, RADIUS = 4, 4


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the labels of ``docs``."""
    return score(docs, train(docs, read(spark, sf_dir, "labels")), only_kept=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_first(docs, WIDTH, RADIUS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; ``n_chars`` follows the text."""
    return redact(docs, size="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left: token count and digests of ids and decoded text."""
    return encode_decode(docs, public_tokenizers.path(llm.TOKENIZER))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
