"""Secret scan with DataFrame functions only: fixed rules, and Markov models for the rest.

Rules find assignments, access keys and long hexadecimal runs. Everything else that looks like
one long token is judged by two character Markov models: one of random strings, one of
ordinary identifiers. Their mean log-likelihood ratio per transition decides. The models are
fitted from labelled samples: random strings from digests of numbers (``RANDOM_STRINGS`` of
each alphabet) and the words of at most ``ORDINARY_DOCS`` documents that the rules leave
alone. Only the counted transitions, a table of fixed size, come to the driver.

Positions are code points, ends exclusive. A match list comes from splitting the text at the
rule and taking the matches with it: piece and match lengths give the positions.

Defined results: NULL and empty texts have no spans; repeated rows are reported for every row;
an empty table gives an empty result (its ordinary model is uniform).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, text_of

#: Labelled samples: random strings of each alphabet, and documents with ordinary words.
RANDOM_STRINGS = 4_000
ORDINARY_DOCS = 2_000
#: Mean log-likelihood ratio per transition from which a token counts as random.
THRESHOLD = 0.5
#: Tokens for the models: characters at least, and different ones among them.
TOKEN_CHARS = 20
DISTINCT_CHARS = 8

KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9+/_=-]+"
_SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"


def _positions(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.arrays_zip(
        F.slice(F.transform(pieces, lambda p: F.char_length(p)), 1, F.size(whole)).alias("before"),
        F.transform(whole, lambda m: F.char_length(m)).alias("own"),
        F.transform(judged, lambda m: F.char_length(m)).alias("judged"),
    )

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["before"]
        end = start + s["own"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(s["judged"] >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))
    return F.aggregate(sizes, empty, step, lambda s: s["spans"])


def _or_none(found: Column, spans: Column) -> Column:
    """``spans`` where a cheap test allows any."""
    return F.when(found, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the rules. Runs of one class are matched whole, so a minimum length in the
    pattern finds the same runs as dropping short matches; an assignment that fails still
    hides what it covers, so short ones are matched and dropped."""
    return F.concat(
        _or_none(text.rlike(f"({_KEYS})"), _positions(text, ASSIGN, 0, 8, group=2)),
        _or_none(text.contains("AKIA"), _positions(text, ACCESS.replace("+", "{12,}"), 1, 16)),
        _or_none(text.rlike("[0-9a-f]{32}"), _positions(text, HEX.replace("+", "{32,}"), 2, 32)),
    )


# ------------------------------------------------------------------------------- models


def _transitions(strings: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of character pairs in column ``s``: at most the square of the alphabet."""
    pairs = strings.where(F.char_length("s") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p")
    )
    # Characters outside the alphabet never occur in a token.
    pairs = pairs.where(F.translate("p", ALPHABET, "") == "").groupBy("p").count()
    return {(r["p"][0], r["p"][1]): r["count"] for r in pairs.collect()}


def random_strings(spark, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled random strings in hexadecimal, base 64 and upper-case alphabets."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    coded = F.translate(F.base64(F.unhex(digest)), "=\r\n", "")
    forms = F.array(digest, coded, F.upper(F.translate(coded, "+/", "")))
    return spark.range(n).select(F.explode(forms).alias("s"))


def ordinary_words(docs: DataFrame, key: str, text: str, n: int = ORDINARY_DOCS) -> DataFrame:
    """Labelled ordinary identifiers: words of the documents whose keys hash lowest and that
    no rule marks."""
    chosen = docs.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(n)
    sample = docs.select(F.col(key), text_of(text).alias("t")).join(F.broadcast(chosen), key)  # at most n rows
    plain = sample.where(F.size(base_spans(F.col("t"))) == 0)
    return plain.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Za-z_-]{2,}"), F.lit(0)))).alias("s"))


def ratio_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """Log-likelihood ratios of all character pairs, random against ordinary, with one count
    added to each pair."""
    random = _transitions(random_strings(docs.sparkSession))
    ordinary = _transitions(ordinary_words(docs, key, text))
    k = len(ALPHABET)

    def logs(counts: dict) -> dict:
        rows = {a: sum(counts.get((a, b), 0) for b in ALPHABET) for a in ALPHABET}
        return {(a, b): math.log((counts.get((a, b), 0) + 1) / (rows[a] + k)) for a in ALPHABET for b in ALPHABET}

    p, q = logs(random), logs(ordinary)
    return [p[a, b] - q[a, b] for a in ALPHABET for b in ALPHABET]


def _mean_ratio(token: Column, table: list[float]) -> Column:
    """Mean ratio over the transitions of a token."""
    values = F.expr("cast(split('" + ",".join(f"{v:.6f}" for v in table) + "', ',') as array<double>)")

    def place(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))

    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(token) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.element_at(values, ((place(i) - 1) * len(ALPHABET) + place(i + 1)).cast("int")),
    )
    return total / (F.char_length(token) - 1)


def random_spans(text: Column, base: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """Spans of the tokens that the models call random, apart from the rules' spans."""
    pattern = TOKEN.removesuffix("+") + f"{{{TOKEN_CHARS},}}"
    spans = _positions(text, pattern, 3, TOKEN_CHARS)

    def is_random(span: Column) -> Column:
        token = F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        apart = ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        varied = F.size(F.array_distinct(F.split(token, ""))) >= DISTINCT_CHARS
        return apart & varied & (_mean_ratio(token, table) > threshold)

    return _or_none(text.rlike(pattern), F.filter(spans, is_random))


# ---------------------------------------------------------------------------- operators


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))

    def one(s: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts by rule, digest of the rules' spans, all spans
    as ``kind:start:end`` by start, then kind. A narrow map; only model fitting aggregates."""
    table = ratio_table(docs, key, text)
    based = docs.select(F.col(key), text_of(text).alias("_text")).withColumn("_base", F.array_sort(base_spans(F.col("_text"))))
    found = based.withColumn("_spans", F.array_sort(F.concat("_base", random_spans(F.col("_text"), F.col("_base"), table))))

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(key, *map(count, range(3)), F.sha2(_said(F.col("_base")), 256).alias("base_sha256"), _said(F.col("_spans")).alias("spans"))


def redact(
    docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", size: str | None = None
) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; rows without spans are unchanged. In
    changed rows the column ``size``, if given, gets the new length."""
    table = ratio_table(docs, key, text)
    whole, base, spans = (fresh(docs, n) for n in ("_text", "_base", "_spans"))
    based = docs.withColumn(whole, text_of(text)).withColumn(base, F.array_sort(base_spans(F.col(whole))))
    found = based.withColumn(spans, F.array_sort(F.concat(base, random_spans(F.col(whole), F.col(base), table))))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(whole, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(whole, (s["at"] + 1).cast("int"), F.char_length(whole)))
    )
    changed = F.size(spans) > 0
    done = found.withColumn(text, F.when(changed, clean).otherwise(F.col(text)))
    if size is not None:
        length = F.char_length(text).cast(docs.schema[size].dataType)
        done = done.withColumn(size, F.when(changed, length).otherwise(F.col(size)))
    return done.drop(whole, base, spans)
