"""Token counts through a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, count). Documents are
joined to it by both digests; only texts without a stored count are encoded, each distinct
one once, and their counts are appended. A retried or repeated append can store a count
twice, so lookups take one row for each digest.

Defined results: NULL counts as the empty text; empty texts have 0 tokens; repeated rows are
encoded once and reported for every row; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import text_of

SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
#: Part of every tokenizer digest; change it when a way of counting changes.
COUNTING_VERSION = "1"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's content and the way of counting, so that a changed file never
    meets counts of the old one."""
    with open(path, "rb") as f:
        return hashlib.sha256(COUNTING_VERSION.encode() + b"\0" + f.read()).hexdigest()


@functools.cache
def counter(path: str) -> Callable[[Iterable[str]], Iterator[int]]:
    """Counting function of a worker: no begin, end or added special tokens, no truncation."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: (len(model.encode(t)) for t in texts)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if bpe.is_byte_level(spec):
        encoder = bpe.encoder(path)
        return lambda texts: (len(ids) // 4 for ids in encoder.encode_all(texts))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return lambda texts: (len(library.encode(t, add_special_tokens=False)) for t in texts)


def content_digest(text: str = "text") -> Column:
    """Digest of the text as it is counted: NULL as empty, nothing else is normalised, since
    any further change could alter a count."""
    return F.sha2(text_of(text).cast("binary"), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def lookup(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """One stored count for each content digest of a tokenizer version."""
    stored = read_cache(spark, cache).where(F.col("tokenizer_digest") == version)
    return stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_misses(docs: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Encode each distinct text that has no stored count, and append its count."""
    version = tokenizer_digest(path)
    texts = docs.select(content_digest(text).alias("content_digest"), text_of(text).alias("_text"))
    known = lookup(docs.sparkSession, cache, version)
    # Equal texts collapse before they are shuffled, so a text that fills a third of the
    # table reaches the next stage once for each task that has it.
    distinct = (
        texts.join(known, "content_digest", "left_anti").groupBy("content_digest").agg(F.first("_text").alias("_text"))
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            counts = list(count(batch["_text"]))
            yield pd.DataFrame({"content_digest": batch["content_digest"], "tokenizer_digest": version, "n_tokens": counts})

    distinct.mapInPandas(encode, SCHEMA).write.mode("append").parquet(cache)


def token_counts(
    docs: DataFrame, path: str, cache: str, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bytes and tokens of each whole text, from the cache that this call brings up to date.

    Returns ``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).
    """
    add_misses(docs, path, cache, text)
    counts = lookup(docs.sparkSession, cache, tokenizer_digest(path))
    narrow = docs.select(
        F.col(key),
        F.octet_length(text_of(text)).cast("long").alias("n_bytes"),
        content_digest(text).alias("content_digest"),
    )
    return narrow.join(counts, "content_digest").select(
        key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
