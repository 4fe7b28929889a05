"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode_decode
from tidemark.llm.common import new_folder, read
from tidemark.llm.decontaminate import leaks
from tidemark.llm.html_text import main_text
from tidemark.llm.merkle import manifest, tampered_leaf
from tidemark.llm.quality import score, train
from tidemark.llm.ranked_search import search
from tidemark.llm.rules import quality_rules
from tidemark.llm.secret_scan import find_secrets
from tidemark.llm.sharding import balanced_shards
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.token_counts import token_counts
from tidemark.llm.url_filter import Rule, judge, mine, rule_labels
from tidemark.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The tokenizer file of the queries; the operators take any path.
TOKENIZER = "byte_bpe_50k.json"

#: The given rules of the url filter.
URL_RULES = [
    Rule("org/", block=False),
    Rule("example.org/es/", block=True),
    Rule("example.org/en/1", block=True),
    Rule("com/fr/", block=False),
    Rule("com/de/", block=True),
]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op2_bpe_encode_decode")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every run counts what it reports."""
    docs = read(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path(TOKENIZER), new_folder(spark, "token-counts"))


@query("op5_simhash_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, radius=4)


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


@query(
    "op7_warc_packages",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
               sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ), g AS (
        SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM g
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


@query("op8_balanced_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read(spark, sf_dir, "documents"), shards=16)


@query("op10_html_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"), claimed=tampered_leaf())


@query(
    "op11_ranked_search",
    r"""
    WITH words AS (
        SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ), tfs AS (
        SELECT doc_id, r, term, count(*) AS tf FROM words GROUP BY ALL
    ), lens AS (
        SELECT r, sum(tf)::BIGINT AS n FROM tfs GROUP BY r
    ), whole AS (
        SELECT count(*) AS c, sum(n)::BIGINT AS l FROM lens
    ), dfs AS (
        SELECT term, count(*) AS df FROM tfs GROUP BY term
    ), asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), scored AS (
        SELECT item_id, doc_id, r,
               sum(floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                   * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * c) // l))))::BIGINT AS score
        FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN lens USING (r) CROSS JOIN whole
        GROUP BY item_id, doc_id, r
    ), ranked AS (
        SELECT item_id, doc_id, score,
               (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=50)


@query("op12_url_filter")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, mine(rule_labels(pages, URL_RULES)))
