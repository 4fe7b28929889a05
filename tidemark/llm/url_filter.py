"""URL filter by association rules.

Given rules (a host and a path, allow or block) decide the urls that they fit: a rule fits its
host and all subdomains where the path starts with the rule's; the longest fitting rule wins.
All other urls are judged by association rules, mined from labelled urls:

1. Every url is a set of tokens: scheme, labels and suffixes of the host, path segments,
   shapes and leading digits of numbers, the extension, names of query parameters, a mark for
   a fragment. Tokens over 64 characters count by their digest.
2. All frequent tokens of every labelled url and its label are mined by Spark's FP-growth; no
   url is cut. So that a url of a thousand segments does not have 2**1000 frequent subsets,
   tokens of the very same urls are mined as one, and each set is counted with its rarest
   token, without the tokens that all urls of that one have. Sets left out this way are as
   sure as a part of theirs, so no rule that stays is missed; the rules get the other tokens
   of the same urls back at the end. Many tokens that are common and free of each other still
   have as many sets as there are.
3. Rules that lead to a label stay with ``min_support`` and ``min_confidence``, unless a rule
   of fewer of their tokens for the same label is at least as sure.
4. An inverted index lists every rule under its rarest token. A url looks up its own tokens
   and takes the surest rule that it holds whole: then the one with more support, then fewer
   tokens, then the first by its tokens. Without any rule it is allowed.

Labels may be any urls with a verdict. The query has no labels of urls among its tables (ids
of ``labels`` are documents'), so the urls that the given rules decide teach it the rest.

Defined results: a NULL url or one without `://` has empty host, path and token set and is
allowed; equal rules' lengths: the longer host wins, then block; repeated rows are judged alike,
and each counts as a transaction; urls of any length count whole; without labelled urls there
are no rules; the empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_keeping, maybe_broadcast, written

#: Tokens that a counting of all subsets could ever see in a url; mining has no such bound.
MAX_ITEMS = 1000
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9

#: Items that stand for the labels; no token starts like this.
ALLOW, BLOCK = "=allow", "=block"

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PLACE = re.compile(r"([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", re.S)
_LONG = 64


# ----------------------------------------------------------------------------- given rules


@dataclass(frozen=True)
class Rule:
    """`host/path` and whether it blocks."""

    text: str
    block: bool

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]

    @property
    def size(self) -> tuple[int, int, bool]:
        return len(self.text), len(self.host), self.block


def split(url: str | None) -> tuple[str, str, str, str, str]:
    """Scheme, host, path, query and fragment; empty without `://`."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", "", "", ""
    host, path, query, fragment = _PLACE.match(rest).groups()
    return scheme, host.translate(_LOWER), path, query or "", fragment or ""


class RuleBook:
    """The given rules by host."""

    def __init__(self, rules: Iterable[Rule]):
        self.of: dict[str, list[Rule]] = defaultdict(list)
        for r in rules:
            self.of[r.host].append(r)

    def find(self, host: str, path: str) -> Rule | None:
        best = None
        while host:
            for r in self.of.get(host, ()):
                if path.startswith(r.path) and (best is None or r.size > best.size):
                    best = r
            host = host.partition(".")[2]
        return best


# ---------------------------------------------------------------------------------- tokens


def tokens_of(url: str | None) -> list[str]:
    """The different tokens of a url, sorted."""
    scheme, host, path, query, fragment = split(url)
    if not host and not path:
        return []
    labels = [x for x in host.split(".") if x]
    # The last two labels are suffixes by themselves.
    out = {f"scheme:{scheme.translate(_LOWER)}"} | {f"label:{x}" for x in labels[:-2]}
    out |= {f"host:{'.'.join(labels[i:])}" for i in range(max(0, len(labels) - 3), len(labels))}
    for segment in path.split("/"):
        name, dot, ext = segment.translate(_LOWER).rpartition(".")
        name = name if dot else ext
        if dot:
            out.add(f"ext:{ext}")
        if name.isascii() and name.isdigit():
            out |= {f"digits:{len(name)}", f"lead:{name[0]}"}
        elif name:
            out |= {f"part:{x}" for x in re.split(r"[-_+]+", name) if x}
    out |= {f"query:{x.partition('=')[0]}" for x in query[1:].split("&") if x}
    if fragment:
        out.add("fragment")
    return sorted({t if len(t) <= _LONG else f"digest:{hashlib.sha1(t.encode('utf-8', 'replace')).hexdigest()}" for t in out})


def _tokens(url: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(tokens_of)

    return run(F.col(url))


# ---------------------------------------------------------------------------------- mining


def _labelled(labelled: DataFrame) -> tuple[DataFrame, int]:
    """``row``, ``tokens`` and ``block`` of every labelled url, and their number."""
    rows = labelled.where(F.col("block").isNotNull()).select(_tokens("url").alias("tokens"), "block")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    return rows, rows.count()


def _classes(rows: DataFrame, least: int) -> DataFrame:
    """Frequent tokens, those of the very same urls together: ``first`` (the first of them),
    ``members`` and ``all``, the number of urls."""
    marks = {f"mark{i}": F.bit_xor(F.xxhash64("row", F.lit(i))) for i in (0, 1)}
    counts = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("all"), *[m.alias(n) for n, m in marks.items()])
    same = counts.where(F.col("all") >= least).groupBy("all", *marks)
    return written(same.agg(F.min("token").alias("first"), F.sort_array(F.collect_list("token")).alias("members")).drop(*marks), "frequent-tokens")


def _transactions(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """For every labelled url and each of its classes, the ``root``: the label and the url's
    commoner classes, each behind the digest of the root. A set is so counted with its rarest
    token alone. Tokens that all urls of the root have are left out: with them no rule of the
    root is surer than without."""
    known = classes.select(F.col("first").alias("token"), "all")
    single = rows.select("row", "block", F.explode("tokens").alias("token"))
    near = single.join(maybe_broadcast(known, known.count(), 2 * _LONG), "token")
    own = near.groupBy("row", "block").agg(F.sort_array(F.collect_list(F.struct("all", "token"))).alias("own"))
    rest = F.transform(F.slice("own", F.col("place") + 2, F.size("own")), lambda x: x["token"])
    rooted = own.select("block", "own", F.posexplode("own").alias("place", "r")).select("block", F.col("r.token").alias("root"), F.col("r.all").alias("all"), rest.alias("rest"))
    rooted = written(rooted, "rooted-urls")
    pairs = rooted.select("root", "all", F.explode("rest").alias("token")).groupBy("root", "all", "token").agg(F.count(F.lit(1)).alias("both"))
    implied = pairs.where(F.col("both") == F.col("all")).groupBy("root").agg(F.collect_list("token").alias("implied"))
    label = F.when(F.col("block"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    free = F.array_except("rest", F.coalesce("implied", F.array().cast("array<string>")))
    items = F.transform(F.concat(F.array(label), free), lambda x: F.concat(F.md5("root"), x))
    return written(rooted.join(implied, "root", "left").select(items.alias("items")), "url-transactions")


def _spread(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules over first tokens, with every choice of tokens of the same classes."""
    members = classes.where(F.size("members") > 1).select(F.col("first").alias("token"), "members")
    each = rules.select("tokens", F.explode("tokens").alias("token")).distinct().join(members, "token", "left")
    options = each.groupBy("tokens").agg(F.collect_list(F.coalesce("members", F.array("token"))).alias("options"))
    none = F.array(F.array().cast("array<string>"))
    chosen = F.aggregate("options", none, lambda made, o: F.flatten(F.transform(made, lambda m: F.transform(o, lambda t: F.concat(m, F.array(t))))))
    spread = rules.join(options, "tokens").withColumn("tokens", F.explode(chosen))
    return spread.withColumn("tokens", F.array_sort("tokens")).drop("options")


def _without(rules: DataFrame, parts: Column) -> DataFrame:
    """``rules`` without those that a rule over one of their ``parts`` (token sets) and of the
    same label matches in confidence."""
    smaller = rules.where(F.size("tokens") > 1).select("tokens", "label", F.explode(parts).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("simpler"))
    best = smaller.join(known, ["part", "label"]).groupBy("tokens", "label").agg(F.max("simpler").alias("simpler"))
    sure = F.col("simpler").isNull() | (F.col("confidence") > F.col("simpler"))
    return rules.join(best, ["tokens", "label"], "left").where(sure).drop("simpler")


def _irredundant(rules: DataFrame) -> DataFrame:
    """Rules without one of fewer of their tokens that is at least as sure. Most fall to a rule
    of one token; all subsets are formed of the rest alone. A rule that falls first cannot be
    missed: what it fell to is a part of the same larger rules, and at least as sure."""
    first = written(_without(rules, F.transform("tokens", lambda t: F.array(t))), "url-rules")
    bits = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("tokens")) - 2)

    def subset(mask: Column) -> Column:
        return F.filter("tokens", lambda _, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)

    return _without(first, F.transform(bits, subset))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules from ``url`` and ``block`` (boolean; rows without are left out):
    ``tokens`` (sorted), ``label``, ``confidence``, ``hits`` (urls with tokens and label) and
    ``rarest``, the token with the fewest labelled urls."""
    rows, n = _labelled(labelled)
    schema = "tokens array<string>, label string, confidence double, hits long, rarest string"
    least = math.ceil(min_support * n)
    classes = _classes(rows, least) if n else None
    if not n or classes.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    items = _transactions(rows, classes)
    # The rate that stands for ``least`` of these transactions.
    rate = max(0.0, (least - 0.5) / items.count())
    model = FPGrowth(itemsCol="items", minSupport=rate, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.select(F.substring(F.col("items")[0], 1, 32).alias("digest"), F.transform("items", lambda x: x.substr(F.lit(33), F.length(x))).alias("items"), "freq")
    roots = classes.select(F.md5("first").alias("digest"), F.col("first").alias("root"))
    # A set with its label, against the set without.
    label = F.get(F.filter("items", lambda x: x.isin(ALLOW, BLOCK)), 0)
    tokens = F.array_sort(F.concat(F.array("root"), F.filter("items", lambda x: ~x.isin(ALLOW, BLOCK))))
    whole = written(sets.join(roots, "digest").select(label.alias("label"), tokens.alias("tokens"), "freq"), "frequent-sets")
    left = whole.where(F.col("label").isNull()).select("tokens", F.col("freq").alias("all")).unionByName(classes.select(F.array("first").alias("tokens"), "all"))
    rules = whole.where(F.col("label").isNotNull()).join(left, "tokens")
    rules = rules.select("tokens", "label", (F.col("freq") / F.col("all")).alias("confidence"), F.col("freq").alias("hits"))
    rules = written(rules.where((F.col("confidence") >= min_confidence) & (F.col("hits") >= min_support * n)), "url-rules")
    rules = written(_spread(_irredundant(rules), classes), "url-rules")
    single = classes.select(F.explode("members").alias("token"), "all")
    few = rules.select("tokens", F.explode("tokens").alias("token")).distinct().join(single, "token")
    rarest = few.groupBy("tokens").agg(F.min(F.struct("all", "token")).alias("r")).select("tokens", F.col("r.token").alias("rarest"))
    return written(rules.join(rarest, "tokens").select("tokens", "label", "confidence", "hits", "rarest"), "url-rules")


# --------------------------------------------------------------------------------- judging


class RuleIndex:
    """Mined rules by their rarest token."""

    def __init__(self, rows: Iterable):
        self.of: dict[str, list[tuple]] = defaultdict(list)
        for r in rows:
            tokens = tuple(r["tokens"])
            rank = (-r["confidence"], -r["hits"], len(tokens), tokens, r["label"])
            self.of[r["rarest"]].append((rank, frozenset(tokens), r))

    def best(self, tokens: Sequence[str]):
        own = set(tokens)
        fitting = [(rank, r) for t in tokens for rank, needs, r in self.of.get(t, ()) if needs <= own]
        return min(fitting, key=lambda x: x[0])[1] if fitting else None


def judge(pages: DataFrame, rules: Sequence[Rule], mined: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each row of ``pages``: ``key``, ``host``, ``path``, ``rule`` (the given rule
    that decides, or NULL), ``verdict`` (allow or block), and of the mined rule that decides
    ``tokens`` and ``confidence``. A narrow map; rules and index are broadcast."""
    sc = pages.sparkSession.sparkContext
    held = sc.broadcast((RuleBook(rules), RuleIndex(mined.collect())))

    def work(batch: pd.DataFrame) -> dict[str, list]:
        book, index = held.value
        out: dict[str, list] = {c: [] for c in ("host", "path", "rule", "verdict", "tokens", "confidence")}
        for u in batch["_url"]:
            _, host, path, _, _ = split(u)
            rule = book.find(host, path)
            found = None if rule else index.best(tokens_of(u))
            block = rule.block if rule else found is not None and found["label"] == BLOCK
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(rule.text if rule else None)
            out["verdict"].append("block" if block else "allow")
            out["tokens"].append(found["tokens"] if found else None)
            out["confidence"].append(found["confidence"] if found else None)
        return out

    rows = pages.select(F.col(key), F.col(url).cast("string").alias("_url"))
    return map_keeping(rows, [key], work, "host string, path string, rule string, verdict string, tokens array<string>, confidence double")


def rule_labels(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Labelled urls for ``mine``: those that a given rule decides, as it decides."""
    book = pages.sparkSession.sparkContext.broadcast(RuleBook(rules))

    @F.pandas_udf("boolean")
    def blocked(urls: pd.Series) -> pd.Series:
        found = [book.value.find(*split(u)[1:3]) for u in urls]
        return pd.Series([None if r is None else r.block for r in found], dtype=object)

    return pages.select(F.col(url).cast("string").alias("url")).withColumn("block", blocked("url")).where("block IS NOT NULL")
