"""Balanced label propagation: linked documents into shards of equal row counts.

Documents with equal texts are linked. They start in hashed shards. In each round Spark joins
every linked document to its group's shard histogram; the group's target is the shard that
holds most of it, and documents elsewhere ask to move there. Moves are granted under capacity
quotas: a shard takes what fits below its ceiling, counting those that leave it in the same
round, so every origin's requests are granted in the share that fits. A group moves as a whole where its target has room for it; one that is
larger than a shard's ceiling is divided by blocks of its members, so it fills shards one by
one. A last pass makes the counts exact: shards above their quota release rows, unlinked ones
first, and shards below take them.

The law held is ``rows``: shard sizes differ by one at most. Everything is DataFrame
functions; only tables of shards by shards come to the driver.

Defined results: NULL and empty texts are equal texts of no bytes; rows with a NULL key, and
rows that repeat a key, are placed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, maybe_broadcast, text_of
from tidemark.operators.order import row_index

#: Rounds of moves at most; fewer when no document asks to move.
ROUNDS = 6
#: Room for linked documents beyond an equal share; the last pass would take it back.
SLACK = 0.0


def _nodes(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """Narrow rows: key, size, checksum, group digest, and the first shard."""
    raw = text_of(text).cast("binary")
    return docs.select(
        F.col(key).alias("_key"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.sha1(raw).alias("_group"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("shard", F.pmod(F.xxhash64("_key", "_row"), F.lit(shards)).cast("int"))


def _array(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _counts(nodes: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _block(members: Column, ceiling: int) -> Column:
    """Which block of its group a member belongs to: blocks have about half a ceiling of
    members, so that several of them fit a shard."""
    blocks = F.ceil(members * 2 / F.lit(max(1, ceiling)))
    return F.when(members > ceiling, F.pmod(F.xxhash64("_row"), blocks)).otherwise(F.lit(0)).cast("int")


def _grants(counts: list[int], flow: dict[tuple[int, int], int], ceiling: int) -> list[float]:
    """The share of its requests that each shard grants: all, or what fits below the ceiling
    once those have left that other shards take in."""
    shards = range(len(counts))
    asked = [sum(n for (_, b), n in flow.items() if b == s) for s in shards]
    grant = [1.0 if asked[s] else 0.0 for s in shards]
    for _ in range(50):
        leaving = [sum(n * grant[b] for (a, b), n in flow.items() if a == s) for s in shards]
        grant = [min(grant[s], max(0.0, ceiling - counts[s] + leaving[s]) / asked[s]) if asked[s] else 0.0 for s in shards]
    return grant


def propagate(nodes: DataFrame, shards: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """Rounds of moves; ``nodes`` with its ``shard`` moved towards linked documents."""
    total = nodes.count()
    ceiling = int(total / shards * (1 + slack)) + 1
    # Groups: one row each, from counts that are partial before they are shuffled.
    sizes = nodes.groupBy("_group").agg(F.count(F.lit(1)).alias("_members"))
    linked = checkpointed(sizes.where(F.col("_members") > 1))
    if linked.isEmpty():
        return nodes.withColumn("_block", F.lit(None).cast("int"))
    marked = nodes.join(maybe_broadcast(linked, linked.count(), 80), "_group", "left")
    nodes = checkpointed(marked.withColumn("_block", F.when(F.col("_members").isNotNull(), _block(F.col("_members"), ceiling))))
    for number in range(rounds):
        held = nodes.where(F.col("_block").isNotNull())
        # Only linked documents use up a shard: the others give way in the last pass.
        counts = _counts(held, shards)
        # Histogram of each group (or block of one) over the shards, and its best shard among
        # those with room; among equals a hash that differs by group, so that ties do not
        # crowd into one shard.
        seen = held.groupBy("_group", "_block", "shard").agg(F.count(F.lit(1)).alias("n"))
        room = F.element_at(_array([c < ceiling for c in counts]), F.col("shard") + 1)
        best = F.max_by("shard", F.struct(room.alias("room"), "n", F.xxhash64("_group", "_block", "shard"))).alias("target")
        wanted = seen.groupBy("_group", "_block").agg(best, F.count(F.lit(1)).alias("_places"), F.max(room).alias("_room"))
        wanted = wanted.where("_places > 1 AND _room")
        # Requests from shard to shard: at most shards times shards rows.
        flow = (
            seen.join(wanted.select("_group", "_block", "target"), ["_group", "_block"])
            .where("shard <> target")
            .groupBy("shard", "target")
            .agg(F.sum("n").alias("n"))
            .collect()
        )
        if not flow:
            break
        grant = _grants(counts, {(r["shard"], r["target"]): r["n"] for r in flow}, ceiling)
        if not any(grant):
            break
        luck = F.pmod(F.xxhash64("_group", "_block", F.lit(number)), F.lit(1 << 20)) / (1 << 20)
        granted = checkpointed(
            wanted.where(luck < F.element_at(_array(grant), F.col("target") + 1)).select("_group", "_block", "target")
        )
        if granted.isEmpty():
            continue
        side = maybe_broadcast(granted, granted.count(), 80)
        moved = nodes.join(side, ["_group", "_block"], "left")
        nodes = checkpointed(moved.withColumn("shard", F.coalesce("target", "shard")).drop("target"))
    return nodes


def settle(nodes: DataFrame, shards: int) -> DataFrame:
    """Exact counts: ``nodes`` with final ``shard`` and gapless ``slot``.

    Rows are numbered within their shard, linked ones first and group by group. Those past the
    shard's quota are released and fill the shards below quota in order.
    """
    counts = _counts(nodes, shards)
    total = sum(counts)
    base, more = divmod(total, shards)
    # The larger quotas go to the fullest shards, which then release least.
    fullest = set(sorted(range(shards), key=lambda s: (-counts[s], s))[:more])
    quota = [base + (s in fullest) for s in range(shards)]
    released, open_at, first_release, first_open = 0, 0, [], []
    for s in range(shards):
        first_release.append(released)
        released += max(0, counts[s] - quota[s])
        first_open.append(open_at)
        open_at += max(0, quota[s] - counts[s])
    order = nodes.withColumn("_alone", F.col("_block").isNull()).withColumn("_by", F.coalesce(F.xxhash64("_group", "_block"), F.lit(0)))
    placed = row_index(order, ["_alone", "_by", "_key", "_row"], group=["shard"], name="_place")

    own = F.col("shard") + 1
    rank = F.col("_place") - 1
    stays = rank < F.element_at(_array(quota), own)
    number = F.element_at(_array(first_release), own) + rank - F.element_at(_array(quota), own)
    # The shard whose open places begin last at or before the released row's number.
    takers = [s for s in range(shards) if quota[s] > counts[s]]
    target, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in takers:
        inside = (number >= first_open[s]) & (number < first_open[s] + quota[s] - counts[s])
        target = F.when(inside, F.lit(s)).otherwise(target)
        slot = F.when(inside, number - first_open[s] + counts[s]).otherwise(slot)
    return placed.withColumn("_stays", stays).withColumns(
        {
            "_target": F.when(F.col("_stays"), F.col("shard")).otherwise(target).cast("int"),
            "slot": F.when(F.col("_stays"), rank).otherwise(slot).cast("long"),
        }
    ).withColumn("shard", F.col("_target")).drop("_target", "_stays", "_place", "_alone", "_by")


def balanced_shards(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, slack: float = SLACK
) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``size`` (bytes plus 1), ``text_crc32``,
    ``law`` (``rows``), ``shard``, ``slot`` and ``grown_shard`` (NULL under this law)."""
    nodes = checkpointed(_nodes(docs, key, text, shards))
    done = settle(propagate(nodes, shards, rounds, slack), shards)
    return done.select(
        F.col("_key").alias(key),
        "size",
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
