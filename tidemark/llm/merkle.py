"""Merkle manifest of a table, with the proof of every row, by butterfly exchange.

Every row is a leaf: the SHA-256 of its fields, each `-` where NULL, else byte length, colon
and value. Leaves stand in the order of the key within their group (a language); every
``fanout`` consecutive nodes, the last ones fewer, become the hash of their concatenated
digests, until one is left, the group's subroot. Subroots in the order of their group (NULL
first) go on in the same way to the root.

The leaves of a group are cut into aligned blocks of ``fanout ** LEVELS`` rows, the partitions
of the exchange; a block computes its own subtree. Then, round by round, the members of a run
of ``fanout`` neighbouring subtrees swap their roots: every block sends the root that it holds
to one block of each other subtree (to several, where the last subtree has fewer blocks), so
that each block holds the whole run, hashes the ancestor itself and keeps the siblings. After
one round for each level every block knows the root and the upper part of its proofs; nothing
is passed down again. A round is one shuffle of a row for each block and member of its run.

Only digests are sorted and shuffled, never texts. A block's task holds ``fanout ** LEVELS``
digests, whatever the groups' sizes. Groups may be many: their numbers and offsets are tables.

Defined results: a NULL field is part of the leaf as `-`; a NULL key comes first in its group,
NULL is a group of its own beside the empty string; rows with equal keys stand in the order of
their leaves, so equal rows have equal leaves at different places and proofs; a text of any
length is hashed whole; a group of one row has its leaf as subroot, a table of one group has
the subroot as root; the empty table has no rows and no root. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidemark.llm.common import maybe_broadcast, text_of, written
from tidemark.operators.order import bucket_bounds, row_index, running_totals

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels of the tree inside a block.
LEVELS = 4

_PROOF = "array<struct<place: int, siblings: array<string>>>"
_STATE = ["p", "g", "b", "blocks", "start", "grp", "absent", "node", "subroot", "proof"]


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of a row's fields, in lowercase hex."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof: at each level the node is put at its
    place among its siblings and the run is hashed."""

    def up(node: Column, level: Column) -> Column:
        place, rest = level["place"], level["siblings"]
        run = F.concat(F.slice(rest, F.lit(1), place), F.array(node), F.slice(rest, place + 1, F.size(rest)))
        return F.sha2(F.array_join(run, ""), 256)

    return F.aggregate(proof, leaf, up)


# ------------------------------------------------------------------------- inside a block


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves: list[str], fanout: int, most: int | None = None) -> list[list[str]]:
    """The nodes of each level: until one is left, or of ``most`` levels above the leaves."""
    out = [leaves]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_hash("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def _siblings(level: list[str], i: int, fanout: int) -> list[str]:
    first = i - i % fanout
    return level[first:i] + level[i + 1 : first + fanout]


def _block_roots(numbered: DataFrame, fanout: int) -> DataFrame:
    """A row for each block: its rows, its root as part of a larger group (``tall``) and as a
    whole group (``lone``)."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        leaves = [x.hex() for x in rows["leaf"].to_pylist()]
        out = {
            "grp": key[0].as_py(),
            "absent": key[1].as_py(),
            "b": key[2].as_py(),
            "n": len(leaves),
            "lone": levels_of(leaves, fanout)[-1][0],
            "tall": levels_of(leaves, fanout, LEVELS)[-1][0],
        }
        return pa.table({k: [v] for k, v in out.items()})

    keyed = numbered.select("grp", "absent", "b", "position", "leaf")
    return keyed.groupBy("grp", "absent", "b").applyInArrow(run, "grp string, absent boolean, b long, n long, lone string, tall string")


# ----------------------------------------------------------------------------- the exchange


def _swap(state: DataFrame, targets: Column, place: Column, active: Column) -> DataFrame:
    """One round: every block sends its node to ``targets`` and itself; whoever is ``active``
    hashes what has come in and adds the others to its proof."""
    sent = state.withColumns({"_place": place, "_active": active}).withColumn(
        "_to", F.concat(F.array("p"), F.when(F.col("_active"), targets).otherwise(F.array().cast("array<bigint>")))
    )
    own = F.struct(*_STATE, "_place", "_active")
    mail = sent.select(own.alias("own"), F.struct("_place", "node").alias("item"), F.posexplode("_to").alias("at", "to"))
    mail = mail.withColumn("own", F.when(F.col("at") == 0, F.col("own")))
    got = mail.groupBy("to").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("item")).alias("run"))
    others = F.transform(F.filter("run", lambda x: x["_place"] != F.col("own._place")), lambda x: x["node"])
    level = F.struct(F.col("own._place").cast("int").alias("place"), others.alias("siblings"))
    new = {
        "node": F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), ""), 256),
        "proof": F.concat("own.proof", F.array(level)),
    }
    return got.select(
        *[(F.when(F.col("own._active"), new[c]).otherwise(F.col(f"own.{c}")) if c in new else F.col(f"own.{c}")).alias(c) for c in _STATE]
    )


def _served(low: Column, size: Column, start: Column, length: Column) -> Column:
    """Blocks of a neighbouring subtree (``start``, ``length``) that the block at offset
    ``low`` of its own subtree of ``size`` blocks sends to."""
    return F.when(low < length, F.transform(F.sequence(low, length - 1, size), lambda x: start + x)).otherwise(
        F.array().cast("array<bigint>")
    )


def _group_round(state: DataFrame, step: int, fanout: int) -> DataFrame:
    """Subtrees of ``step`` blocks of one group swap their roots."""
    tree, trees = F.floor(F.col("b") / step), F.ceil(F.col("blocks") / step)
    first = tree - tree % fanout
    low, size = F.col("b") - tree * step, F.least(F.lit(step), F.col("blocks") - tree * step)

    def to(other: Column) -> Column:
        return _served(low, size, F.col("start") + other * step, F.least(F.lit(step), F.col("blocks") - other * step))

    others = F.filter(F.sequence(first, F.least(first + fanout, trees) - 1), lambda x: x != tree)
    return _swap(state, F.flatten(F.transform(others, to)), tree % fanout, trees > 1)


def _top_round(state: DataFrame, groups: DataFrame, step: int, fanout: int, n: int) -> DataFrame:
    """Subtrees of ``step`` groups swap their roots."""
    trees = groups.groupBy(F.floor(F.col("g") / step).alias("tree")).agg(F.min("start").alias("start"), F.sum("blocks").alias("length"))
    member = F.struct(F.col("tree"), F.col("start"), F.col("length"))
    runs = trees.groupBy(F.floor(F.col("tree") / fanout).alias("_run")).agg(F.sort_array(F.collect_list(member)).alias("_members"))
    tree = F.floor(F.col("g") / step)
    placed = state.join(maybe_broadcast(runs, n // (step * fanout) + 1, 32 * fanout), F.floor(tree / fanout) == F.col("_run"))
    mine = F.element_at(F.filter("_members", lambda m: m["tree"] == tree), 1)
    placed = placed.withColumn("_mine", mine)
    low, size = F.col("p") - F.col("_mine.start"), F.col("_mine.length")
    others = F.filter("_members", lambda m: m["tree"] != F.col("_mine.tree"))
    targets = F.flatten(F.transform(others, lambda m: _served(low, size, m["start"], m["length"])))
    return _swap(placed, targets, F.col("_mine.tree") % fanout, F.lit(True))


def _exchange(roots: DataFrame, fanout: int) -> DataFrame:
    """Root, subroot and upper proof of every block."""
    sizes = roots.groupBy("grp", "absent").agg(F.count(F.lit(1)).alias("blocks"))
    order = row_index(sizes.withColumn("named", ~F.col("absent")), ["named", "grp"], name="g").withColumn("g", F.col("g") - 1)
    order = written(order.select("grp", "absent", "blocks", "g"), "merkle-groups")
    summed = running_totals(order, [], "g", ["blocks"], bucket_bounds(order, "g"), descending=False)
    groups = written(summed.select("grp", "absent", "blocks", "g", (F.col("cum_blocks") - F.col("blocks")).alias("start")), "merkle-groups")
    n, most, size = groups.agg(F.count(F.lit(1)), F.max("blocks"), F.sum(F.octet_length("grp") + 40)).first()
    named = roots.join(maybe_broadcast(groups, 1, size or 0), ["grp", "absent"])
    node = F.when(F.col("blocks") > 1, F.col("tall")).otherwise(F.col("lone"))
    state = named.withColumns(
        {"p": F.col("start") + F.col("b"), "node": node, "subroot": F.lit(None).cast("string"), "proof": F.array().cast(_PROOF)}
    ).select(*_STATE)
    step = 1
    while step < (most or 0):
        state = written(_group_round(state, step, fanout), "merkle-round")
        step *= fanout
    state = state.withColumn("subroot", F.col("node"))
    step = 1
    while step < n:
        state = written(_top_round(state, groups, step, fanout, n), "merkle-round")
        step *= fanout
    return state.withColumnRenamed("node", "root")


# --------------------------------------------------------------------------------- manifest


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    claimed: Column | None = None,
    fanout: int = 8,
    with_proof: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of all siblings, level by level), ``folded_root``, recomputed from the
    ``claimed`` leaf (a column over ``docs``; by default the row's own) and the siblings, and
    ``verified``, whether that is the root. With ``with_proof`` also ``proof``, an array of
    levels with the node's place in its run and its siblings; ``fold`` folds it later."""
    absent = F.col(group).isNull()
    leaf = F.unhex(leaf_of([F.col(f) for f in fields]))
    given = leaf if claimed is None else F.unhex(claimed)
    leaves = docs.select(
        F.col(key).alias("k"), text_of(group).alias("grp"), absent.alias("absent"), (~absent).alias("named"), leaf.alias("leaf"),
        F.when(given != leaf, given).alias("claimed"),
    )
    # Written first: sorting reads its input twice, and texts are to be hashed once.
    numbered = row_index(written(leaves, "merkle-unsorted"), ["k", "leaf"], ["named", "grp"])
    numbered = written(numbered.withColumn("b", F.floor((F.col("position") - 1) / fanout**LEVELS)).drop("named"), "merkle-leaves")
    state = _exchange(written(_block_roots(numbered, fanout), "merkle-blocks"), fanout)

    kept = StructType([StructField(key, docs.schema[key].dataType)])
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    made = StructType([StructField(t, StringType()) for t in texts] + [StructField("verified", BooleanType())])
    schema = StructType(kept.fields + made.fields + (StructType.fromDDL(f"proof {_PROOF}").fields if with_proof else []))
    proof_type = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))

    def finish(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        top = above.to_pylist()[0]
        leaves = [x.hex() for x in rows["leaf"].to_pylist()]
        levels = levels_of(leaves, fanout, LEVELS if top["blocks"] > 1 else None)
        upper = "".join("".join(x["siblings"]) for x in top["proof"])
        ends = [(x["place"], "".join(x["siblings"][: x["place"]]), "".join(x["siblings"][x["place"] :])) for x in top["proof"]]
        tails = [upper]  # what follows in the proofs of the nodes of a level
        for level in reversed(levels[1:-1]):
            tails = ["".join(_siblings(level, i, fanout)) + tails[i // fanout] for i in range(len(level))]
        proofs, folded = [], []
        for i, claim in enumerate(rows["claimed"].to_pylist()):
            own = "".join(_siblings(leaves, i, fanout)) + tails[i // fanout] if len(levels) > 1 else upper
            proofs.append(_hash(own))
            node, at = leaves[i] if claim is None else claim.hex(), i
            for level in levels[:-1]:
                first = at - at % fanout
                node = _hash("".join(level[first:at]) + node + "".join(level[at + 1 : first + fanout]))
                at //= fanout
            for _, left, right in ends:
                node = _hash(left + node + right)
            folded.append(node)
        n = len(leaves)
        out = {
            key: rows["k"], "leaf": leaves, "subroot": [top["subroot"]] * n, "root": [top["root"]] * n, "proof_sha256": proofs,
            "folded_root": folded, "verified": [f == top["root"] for f in folded],
        }
        if with_proof:
            whole = []
            for i in range(n):
                own = []
                for k, level in enumerate(levels[:-1]):
                    at = i // fanout**k
                    own.append({"place": at % fanout, "siblings": _siblings(level, at, fanout)})
                whole.append(own + top["proof"])
            out["proof"] = pa.array(whole, proof_type)
        return pa.table(out)

    by = ["grp", "absent", "b"]
    return numbered.groupBy(*by).cogroup(state.groupBy(*by)).applyInArrow(finish, schema)


def lowered(text: Column) -> Column:
    """Letters A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_leaf(key: str = "doc_id", text: str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """The leaf of a row whose text was changed in transit: where 3 divides the CRC-32 of the
    key's decimal form the text's letters A-Z are lower case."""
    hit = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 0, F.lit(False))
    return leaf_of([F.when(hit, lowered(F.col(f))).otherwise(F.col(f)) if f == text else F.col(f) for f in fields])
