"""Gradient-boosted trees over binned features, for labels 0 and 1.

Features are cut into at most ``bins`` bins once; a row is its bins (one byte each), its label
and its margin, and rows are written in blocks. Trees grow from histograms: sums of gradient
and hessian and a count for every (node, feature, bin). A histogram pass is one Spark job: every
task adds up its blocks into one array for all asked nodes, arrays are summed by a tree of
tasks, and one array (nodes x features x bins, whatever the rows) comes to the driver, which
picks the splits.

- ``grow="leaf"``: best first, the leaf of the highest gain is split next, up to ``leaves``.
  One pass asks for the children of every leaf that could still be split, so a tree takes about
  as many passes as it is deep, and is the same as if leaves were split one at a time.
- ``grow="depth"``: every leaf with a gain is split, down to ``depth``.
- ``grow="oblivious"``: all nodes of a level share the split of the highest summed gain.

Of two children only the one with fewer rows is counted, the other is parent minus child.

Early stopping grows one tree a round and nothing twice: each tree is added to the margins that
are kept, and every ``refresh`` rounds they are written, which cuts the lineage. The first pass of a
round also sums the loss of the rows held out, so stopping costs no job. The model keeps the
trees up to the best round; exactly ``patience`` more were grown.

Up to ``ONE_TASK_CELLS``, a pass takes less time than the start of a job: one task then reads all
blocks and grows all trees, by the same rules and sums.

Gradients, hessians and losses are summed as whole numbers of 2**-20: sums do not depend on
the order of rows or partitions, so a fit is reproducible and survives lost executors unchanged.
"""

from __future__ import annotations

import functools
import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import drop_table, write_table

#: Unit of the summed gradients, hessians and losses.
SCALE = 1 << 20

#: Rows of a block; tasks and bytes up to which the driver adds up their histograms itself, not
#: by a tree of tasks. The sums are the same.
TASK_ROWS = 25_000
FEW_TASKS = 256
FEW_BYTES = 32 << 20

#: Rows (held out ones too) times features up to which one task grows all trees, in some 100 MB; rows
#: whose cells are summed at once there.
ONE_TASK_CELLS = 10_000_000
CELL_ROWS = 4_096

_GROWTH = ("leaf", "depth", "oblivious")


@dataclass(frozen=True)
class BoostParams:
    grow: str = "leaf"
    rounds: int = 100
    rate: float = 0.05
    leaves: int = 31
    depth: int = 0  # 0: no limit for "leaf", 6 for the others
    bins: int = 64
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    row_share: float = 1.0
    row_every: int = 1  # rounds that share a sample of rows
    column_share: float = 1.0
    seed: int = 42
    refresh: int = 20

    def __post_init__(self) -> None:
        if self.grow not in _GROWTH:
            raise ValueError(f"grow is one of {_GROWTH}, not {self.grow!r}")
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must lie between 2 and 256")
        if self.rounds < 1 or self.leaves < 2 or self.refresh < 1 or self.row_every < 1:
            raise ValueError("rounds, refresh and row_every must be at least 1, leaves at least 2")

    @property
    def limit(self) -> int:
        """Depth that no leaf exceeds."""
        return self.depth or (10**6 if self.grow == "leaf" else 6)


@dataclass
class Tree:
    """Nodes in arrays: a row goes to ``left`` when its bin of ``feature`` is at most ``cut``,
    else to the node behind it; ``feature`` -1 marks a leaf, whose ``value`` is added."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def rows_at(self, bins: np.ndarray, rows: np.ndarray, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and which of the rows end there; only the ``wanted`` leaves, if any are named.
        A row is looked at once on each level of its own way."""
        open_ = set(wanted) if wanted is not None else None
        if open_:
            for node in reversed(range(len(self.feature))):  # children stand behind their parents
                if self.feature[node] >= 0 and (self.left[node] in open_ or self.left[node] + 1 in open_):
                    open_.add(node)
        stack = [(0, rows)]
        while stack:
            node, own = stack.pop()
            if not len(own) or (open_ is not None and node not in open_):
                continue
            if self.feature[node] < 0:
                yield node, own
                continue
            right = bins[:, self.feature[node]].take(own) > self.cut[node]
            left = int(self.left[node])
            stack += [(left, own[~right]), (left + 1, own[right])]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins), np.int64)
        for node, rows in self.rows_at(bins, np.arange(len(bins))):
            out[rows] = node
        return out

    def add_to(self, margin: np.ndarray, bins: np.ndarray) -> None:
        for node, rows in self.rows_at(bins, np.arange(len(bins))):
            margin[rows] += self.value[node]


# ------------------------------------------------------------------------------- in tasks


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(ids: np.ndarray, params: BoostParams, round_: int) -> np.ndarray:
    """Which rows, by their id, take part in a round."""
    if params.row_share >= 1:
        return np.ones(len(ids), bool)
    salt = np.uint64((params.seed * 1_000_003 + round_ // params.row_every) % 2**64)
    return _mixed(ids.view(np.uint64) ^ _mixed(np.array([salt]))) < np.uint64(int(params.row_share * 2**64))


def drawn_columns(n: int, params: BoostParams, round_: int) -> np.ndarray:
    """Which features take part in a round."""
    k = max(1, round(params.column_share * n))
    return np.sort(np.random.default_rng([params.seed, round_]).choice(n, k, replace=False))


def derivatives(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss in units of ``1 / SCALE``."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)


def losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.rint((np.logaddexp(0, margin) - y * margin) * SCALE)


#: Unit of the rows in a sum of hessians and rows, and rows up to which such a sum is exact.
COUNT, COUNT_ROWS = 1 << 36, 1 << 16

#: A block of rows: bins (a row each, kept column by column), ids, labels, whether held out, margins.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]

_KINDS = {"bins": np.uint8, "id": np.int64, "y": np.float64, "held": np.bool_, "margin": np.float64}
_BLOCKS = "bins binary, id binary, y binary, held binary, margin binary"


def _packed(block: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes("F")], pa.binary()) for x in block], names=list(_KINDS))


def _unpacked(row, width: int) -> Block:
    bins, *rest = (np.frombuffer(bytes(row[c]), kind) for c, kind in _KINDS.items())
    return bins.reshape(width, -1).T, *rest


def _blocks(table: DataFrame, width: int) -> RDD:
    """The written blocks as arrays, kept in the executors. An RDD, since a pass is a loop over
    arrays, and planning a SQL query for each of thousands of passes took longer than the pass."""
    return table.rdd.map(lambda row: _unpacked(row, width)).persist(StorageLevel.MEMORY_AND_DISK)


def _grown(blocks: RDD, tree: Tree) -> RDD:
    """The blocks with the margins of one more tree, kept once they are read."""

    def more(block: Block) -> Block:
        *rest, margin = block
        margin = margin.copy()
        tree.add_to(margin, rest[0])
        return *rest, margin

    return blocks.map(more).persist(StorageLevel.MEMORY_AND_DISK)


def _add(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _histograms(
    blocks: RDD, tasks: int, params: BoostParams, round_: int, work: Tree, asked: Sequence[int], columns: np.ndarray, with_loss: bool = True
) -> tuple[np.ndarray, float | None]:
    """Histograms (gradient, hessian, rows by feature and bin) of the asked nodes of ``work``
    over the rows drawn, and the mean loss of the rows held out."""
    slot_of = {int(n): i for i, n in enumerate(asked)}
    bins, shape = params.bins, (3, len(columns), len(asked) * params.bins)

    def run(part: Iterator[Block]) -> Iterator[tuple[np.ndarray, int, int]]:
        total = np.zeros(shape, np.int64)
        loss = rows = 0
        for own, ids, y, held, margin in part:
            if with_loss:
                loss += int(losses(margin[held], y[held]).sum())
                rows += int(held.sum())
            found = [(slot_of[n], r[drawn(ids[r], params, round_)]) for n, r in work.rows_at(own, np.flatnonzero(~held), asked)]
            if not found:
                continue
            use = np.concatenate([r for _, r in found])
            first = np.repeat([s * bins for s, _ in found], [len(r) for _, r in found])
            for at in range(0, len(use), COUNT_ROWS):
                some, base = use[at : at + COUNT_ROWS], first[at : at + COUNT_ROWS]
                g, h = derivatives(margin[some], y[some])
                h += COUNT  # a sum of both at once, exact in a double
                for j, f in enumerate(columns):
                    cell = base + own[:, f].take(some)
                    total[0, j] += np.bincount(cell, g, shape[2]).astype(np.int64)
                    both = np.bincount(cell, h, shape[2]).astype(np.int64)
                    total[1, j] += both & (COUNT - 1)
                    total[2, j] += both >> 36
        yield total, loss, rows

    parts = blocks.mapPartitions(run)
    if tasks <= FEW_TASKS and tasks * np.prod(shape) * 8 <= FEW_BYTES:
        total, loss, rows = functools.reduce(_add, parts.collect())
    else:
        total, loss, rows = parts.treeReduce(_add)
    hist = np.ascontiguousarray(total.reshape(3, len(columns), len(asked), bins).transpose(2, 1, 3, 0))
    return hist, loss / SCALE / rows if rows else None


# ------------------------------------------------------------------------ growing a tree


def _share(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """What a node adds to the gain."""
    below = h + l2
    return np.where(below > 0, g**2 / np.where(below > 0, below, 1), 0.0)


def gains(hist: np.ndarray, params: BoostParams) -> np.ndarray:
    """Gain of every (feature, cut); minus infinity where a side is too small."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist[:1].sum(axis=1, keepdims=True)
    right = whole - left
    sides = []
    for part in (left, right, whole):
        sides.append(_share(part[..., 0] / SCALE, part[..., 1] / SCALE, params.l2))
    out = sides[0] + sides[1] - sides[2]
    if params.grow != "oblivious":
        for part in (left, right):
            small = (part[..., 2] < params.min_rows) | (part[..., 1] < params.min_hessian * SCALE)
            out = np.where(small, -np.inf, out)
    return out


def _best(gain: np.ndarray) -> tuple[float, int, int] | None:
    """The highest gain with its feature and cut, the first of equal ones."""
    if not gain.size:
        return None
    feature, cut = divmod(int(gain.argmax()), gain.shape[1])
    return (float(gain[feature, cut]), feature, cut) if gain[feature, cut] > 1e-9 else None


@dataclass
class _Node:
    path: str  # turns from the root
    total: np.ndarray  # gradient, hessian, rows
    hist: np.ndarray | None = None
    split: tuple[float, int, int] | None = None
    children: tuple[_Node, _Node] | None = None
    number: int = 0


class _Grower:
    """Grows one tree; ``count(tree, nodes)`` is a histogram pass."""

    def __init__(self, params: BoostParams, columns: np.ndarray, count):
        self.params, self.columns, self.count = params, columns, count
        self.passes = 0
        self.gain: dict[int, float] = {}

    def grow(self) -> Tree:
        root = _Node("", np.zeros(3, np.int64))
        self._numbered(root)
        self.passes += 1
        root.hist = self.count(self._tree(root, False), [0])[0]
        root.total = root.hist[0].sum(axis=0)
        if self.params.grow == "oblivious":
            leaves = self._levels(root)
        else:
            leaves = self._best_first(root)
        for node in leaves:
            node.children = None
        self._numbered(root)
        return self._tree(root, True)

    def _best_first(self, root: _Node) -> list[_Node]:
        p = self.params
        most = p.leaves if p.grow == "leaf" else 2**p.limit
        root.split = self._split_of(root)
        leaves = [root]
        while len(leaves) < most:
            open_ = sorted((n for n in leaves if n.split), key=lambda n: (-n.split[0], len(n.path), n.path))
            if not open_:
                break
            node = open_[0]
            if node.children is None:
                fresh = [n for n in open_[: most - len(leaves)] if n.children is None]
                for n in fresh:
                    self._divide(n, n.split[1], n.split[2])
                if len(leaves) + 1 < most:  # the last split needs nothing of its children
                    self._fill(root, fresh)
            leaves.remove(node)
            leaves += node.children
            self._take(node)
        return leaves

    def _levels(self, root: _Node) -> list[_Node]:
        level = [root]
        for depth in range(self.params.limit):
            total = sum(gains(n.hist, self.params) for n in level)
            split = _best(total)
            if split is None:
                break
            for n in level:
                n.split = split
                self._divide(n, split[1], split[2])
            feature = int(self.columns[split[1]])
            self.gain[feature] = self.gain.get(feature, 0.0) + split[0]
            if depth + 1 < self.params.limit:
                self._fill(root, level)
            level = [c for n in level for c in n.children]
        return level

    def _take(self, node: _Node) -> None:
        feature = int(self.columns[node.split[1]])
        self.gain[feature] = self.gain.get(feature, 0.0) + node.split[0]

    def _split_of(self, node: _Node) -> tuple[float, int, int] | None:
        return _best(gains(node.hist, self.params)) if len(node.path) < self.params.limit else None

    def _divide(self, node: _Node, feature: int, cut: int) -> None:
        left = node.hist[feature, : cut + 1].sum(axis=0)
        node.children = _Node(node.path + "0", left), _Node(node.path + "1", node.total - left)

    def _fill(self, root: _Node, parents: list[_Node]) -> None:
        """Histograms of the parents' children: the smaller one counted, the other the rest."""
        parents = [n for n in parents if len(n.path) + 1 < self.params.limit]
        small = [min(n.children, key=lambda c: (c.total[2], c.path)) for n in parents]
        asked = [c for c in small if c.total[2] > 0]
        self._numbered(root)
        found = {}
        if asked:
            self.passes += 1
            counted = self.count(self._tree(root, False), [c.number for c in asked])
            found = {id(c): h for c, h in zip(asked, counted)}
        for n, c in zip(parents, small):
            other = n.children[1] if c is n.children[0] else n.children[0]
            c.hist = found.get(id(c), np.zeros_like(n.hist))
            other.hist = n.hist - c.hist
            for x in n.children:
                if self.params.grow != "oblivious":
                    x.split = self._split_of(x)

    def _numbered(self, root: _Node) -> list[_Node]:
        """Level by level, children side by side."""
        out = [root]
        for n in out:
            if n.children:
                out += n.children
        for i, n in enumerate(out):
            n.number = i
        return out

    def _tree(self, root: _Node, final: bool) -> Tree:
        nodes = self._numbered(root)
        feature, cut, left = (np.full(len(nodes), -1, np.int64) for _ in range(3))
        value = np.zeros(len(nodes))
        for n in nodes:
            if n.children:
                feature[n.number], cut[n.number] = self.columns[n.split[1]], n.split[2]
                left[n.number] = n.children[0].number
            elif final:
                g, h = n.total[0] / SCALE, n.total[1] / SCALE + self.params.l2
                value[n.number] = -self.params.rate * g / h if h > 0 else 0.0
        return Tree(feature, cut, left, value)


# ------------------------------------------------------------------------------------ model


class _Importances(list):
    def toArray(self) -> np.ndarray:  # noqa: N802  as Spark's vectors
        return np.array(self)


@dataclass
class BoostedTrees:
    """A fitted model: cuts of every feature, the first margin and the trees."""

    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    gain: list[float]
    losses: list[float] = field(default_factory=list)  # of the rows held out, by round
    grown: int = 0

    @property
    def best_round(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> _Importances:  # noqa: N802  as Spark's models
        total = sum(self.gain)
        return _Importances(g / total if total else 0.0 for g in self.gain)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            tree.add_to(out, bins)
        return out

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Add the probability of class 1 of the ``features`` vector."""
        held = df.sparkSession.sparkContext.broadcast(self)  # rounds x leaves numbers

        @F.arrow_udf("double")
        def run(rows: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.float64())
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            return pa.array(1 / (1 + np.exp(-held.value.margins(x))))

        return df.withColumn(name, run(vector_to_array("features")))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        head = {"cuts": [c.tolist() for c in self.cuts], "base": self.base, "gain": self.gain, "losses": self.losses, "grown": self.grown}
        rows = [(-1, json.dumps(head))]
        rows += [(i, json.dumps({k: v.tolist() for k, v in vars(t).items()})) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        rows = sorted((r["tree"], json.loads(r["body"])) for r in spark.read.parquet(path).collect())
        head, trees = rows[0][1], []
        for _, body in rows[1:]:
            kinds = {"feature": np.int64, "cut": np.int64, "left": np.int64, "value": float}
            trees.append(Tree(**{k: np.array(body[k], kind) for k, kind in kinds.items()}))
        return cls([np.array(c, float) for c in head["cuts"]], head["base"], trees, head["gain"], head["losses"], head["grown"])


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of cuts below it; NaN lies behind the last cut."""
    out = np.zeros(x.shape, np.uint8, order="F")
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f], side="left")
    return out


def feature_cuts(rows: DataFrame, width: int, bins: int) -> tuple[list[np.ndarray], int, float]:
    """Upper ends of the bins of each element of the array ``x``: approximate quantiles of all
    rows, without the largest value. With the number of rows and the mean of ``y``, all from one scan."""
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins + 1)])
    value = [F.nullif(F.nanvl(F.col("x")[i], F.lit(None).cast("double")), F.lit(None).cast("double")) for i in range(width)]
    sketches = [F.percentile_approx(v, steps, F.lit(50 * bins)).alias(f"f{i}") for i, v in enumerate(value)]
    *found, n, mean = rows.agg(*sketches, F.count(F.lit(1)), F.avg("y")).first()
    out = []
    for q in found:
        values = np.unique(np.array(q if q is not None else [], float))
        out.append(values[:-1])
    return out, n, mean


@dataclass(frozen=True)
class Binned:
    """Rows in written blocks, ready for any learner of the same label and number of bins."""

    table: DataFrame
    cuts: list[np.ndarray]
    base: float
    bins: int
    one_task: bool  # whether they are few enough for one task

    def drop(self) -> None:
        drop_table(self.table)


# ------------------------------------------------------------------------------- boosting


#: Trees grown, the gain of features in each, the losses of the rows held out and the best round.
Grown = tuple[list[Tree], list[dict[int, float]], list[float], int]


def _boosted(source: _Spread | _Near, width: int, p: BoostParams, patience: int | None, held: bool) -> Grown:
    """Up to ``rounds`` trees; ``source`` counts histograms and adds a tree to the margins."""
    trees: list[Tree] = []
    gained: list[dict[int, float]] = []
    losses_: list[float] = []
    best, at = np.inf, 0

    def note(loss: float | None) -> bool:
        """Whether the wait for a lower loss has run out."""
        nonlocal best, at
        if loss is None or not trees:
            return False
        losses_.append(loss)
        if loss < best:
            best, at = loss, len(trees)
        return patience is not None and len(trees) - at >= patience

    for round_ in range(p.rounds):
        columns = drawn_columns(width, p, round_)
        over = []

        def count(tree: Tree, asked: Sequence[int]) -> np.ndarray:
            found, loss = source.count(round_, tree, asked, columns, not over)
            if not over:
                over.append(note(loss))
                if over[0]:
                    raise StopIteration
            return found

        grower = _Grower(p, columns, count)
        try:
            tree = grower.grow()
        except StopIteration:
            break
        trees.append(tree)
        gained.append(grower.gain)
        source.add(tree)
    else:
        if held:
            empty = Tree(np.array([-1]), np.array([0]), np.array([0]), np.array([0.0]))
            note(source.count(p.rounds, empty, [], np.arange(0), True)[1])
    return trees, gained, losses_, at


class _Spread:
    """Rows in the executors: a histogram pass is a job."""

    def __init__(self, rows: Binned, params: BoostParams):
        self.rows, self.params, self.width = rows, params, len(rows.cuts)
        self.table = rows.table
        self.kept = [_blocks(self.table, self.width)]
        self.pending: list[Tree] = []

    def count(
        self, round_: int, tree: Tree, asked: Sequence[int], columns: np.ndarray, with_loss: bool
    ) -> tuple[np.ndarray, float | None]:
        blocks = self.kept[-1]
        return _histograms(blocks, blocks.getNumPartitions(), self.params, round_, tree, asked, columns, with_loss)

    def add(self, tree: Tree) -> None:
        self.pending.append(tree)
        for old in self.kept[:-1]:  # the next margins are made from the last ones
            old.unpersist()
        self.kept = self.kept[-1:]
        if len(self.pending) == self.params.refresh:
            old_table, self.table = self.table, self._refreshed()
            self.pending = []
            self._drop(old_table)
            self.kept = [_blocks(self.table, self.width)]
        else:
            self.kept.append(_grown(self.kept[-1], tree))

    def _refreshed(self) -> DataFrame:
        """The blocks with the margins of all trees so far, written anew."""
        width, pending = self.width, self.pending

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    *rest, margin = _unpacked(row, width)
                    margin = margin.copy()
                    for tree in pending:
                        tree.add_to(margin, rest[0])
                    yield _packed((*rest, margin))

        return write_table(self.table.mapInArrow(run, _BLOCKS), "boost-rows")

    def _drop(self, table: DataFrame) -> None:
        for blocks in self.kept:
            blocks.unpersist()
        if table is not self.rows.table:
            drop_table(table)

    def drop(self) -> None:
        self._drop(self.table)


class _Near:
    """Rows in the task that grows the trees. Within a round, derivatives are taken once and the
    rows of a node are found once, from those of its parent."""

    def __init__(self, blocks: Sequence[Block], params: BoostParams):
        self.params = params
        bins, ids, y, held, self.margin = (np.concatenate(x) for x in zip(*blocks))
        self.bins = np.asfortranarray(bins)
        self.ids, self.y, self.own, self.held = ids, y, np.flatnonzero(~held), np.flatnonzero(held)
        # Every (feature, bin) is a cell; a row is the cells it falls into.
        self.cells = bins.astype(np.intp) + np.arange(bins.shape[1]) * params.bins
        self.known: dict[str, np.ndarray] = {}
        self.drawn: tuple[int | None, np.ndarray] = None, self.own

    def count(
        self, round_: int, tree: Tree, asked: Sequence[int], columns: np.ndarray, with_loss: bool
    ) -> tuple[np.ndarray, float | None]:
        loss = None
        if with_loss and len(self.held):
            at = self.held
            loss = int(losses(self.margin[at], self.y[at]).sum()) / SCALE / len(at)
        if not self.known:
            sample = round_ // self.params.row_every
            if self.drawn[0] != sample:
                self.drawn = sample, self.own[drawn(self.ids[self.own], self.params, round_)]
            self.known[""] = self.drawn[1]
            self.g, self.h = derivatives(self.margin, self.y)
            self.h += COUNT  # a sum of both at once, exact in a double
        out = np.zeros((len(asked), len(columns), self.params.bins, 3), np.int64)
        slot_of = {int(n): i for i, n in enumerate(asked)}
        for node, rows in self._rows_at(tree, slot_of):
            out[slot_of[node]] = self._sums(rows)[columns]
        return out, loss

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        width, bins = self.cells.shape[1], self.params.bins
        total = np.zeros((3, width * bins), np.int64)
        for at in range(0, len(rows), CELL_ROWS):
            some = rows[at : at + CELL_ROWS]
            cells = self.cells.take(some, axis=0).ravel()
            total[0] += np.bincount(cells, np.repeat(self.g[some], width), width * bins).astype(np.int64)
            both = np.bincount(cells, np.repeat(self.h[some], width), width * bins).astype(np.int64)
            total[1] += both & (COUNT - 1)
            total[2] += both >> 36
        return total.reshape(3, width, bins).transpose(1, 2, 0)

    def _rows_at(self, tree: Tree, asked: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
        """The asked leaves and the drawn rows that end there."""
        open_ = set(asked)
        for node in reversed(range(len(tree.feature))):  # children stand behind their parents
            if tree.feature[node] >= 0 and (tree.left[node] in open_ or tree.left[node] + 1 in open_):
                open_.add(node)
        stack = [(0, "")] if open_ else []
        while stack:
            node, path = stack.pop()
            if node not in open_:
                continue
            if tree.feature[node] < 0:
                yield node, self.known[path]
                continue
            if path + "0" not in self.known:
                rows = self.known[path]
                right = self.bins[:, tree.feature[node]].take(rows) > tree.cut[node]
                self.known[path + "0"], self.known[path + "1"] = rows[~right], rows[right]
            left = int(tree.left[node])
            stack += [(left, path + "0"), (left + 1, path + "1")]

    def add(self, tree: Tree) -> None:
        self.known = {}
        tree.add_to(self.margin, self.bins)


def _in_passes(rows: Binned, params: BoostParams, patience: int | None, held: bool) -> Grown:
    source = _Spread(rows, params)
    found = _boosted(source, len(rows.cuts), params, patience, held)
    source.drop()
    return found


def _in_one_task(rows: Binned, params: BoostParams, patience: int | None, held: bool) -> Grown:
    width = len(rows.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_unpacked(row, width) for batch in batches for row in batch.to_pylist()]
        found = _boosted(_Near(blocks, params), width, params, patience, held)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["grown"])

    return pickle.loads(rows.table.coalesce(1).mapInArrow(run, "grown binary").collect()[0]["grown"])


class HistogramBooster:
    """Estimator of ``BoostedTrees`` over an assembled ``features`` vector."""

    def __init__(self, label: str, params: BoostParams):
        self.label, self.params = label, params

    def binned(self, train: DataFrame, held: DataFrame | None = None, cuts: list[np.ndarray] | None = None) -> Binned:
        """The rows in blocks, written once. Learners that differ in how they grow can share them.
        ``cuts`` are those of the same rows, if they are known.

        Rows are binned where they are read, so blocks are moved and not rows.
        """
        others = [c for c in train.columns if c != "features"]

        def narrow(df: DataFrame, is_held: bool) -> DataFrame:
            x = vector_to_array("features")
            y = F.col(self.label).cast("double")
            return df.where(F.col(self.label).isNotNull()).select(
                F.xxhash64(*others, x).alias("id"), y.alias("y"), F.lit(is_held).alias("held"), x.alias("x")
            )

        own = narrow(train, False)
        if cuts is None:
            first = own.select(F.size("x").alias("n")).first()
            if first is None:
                raise ValueError("no labelled rows to learn from")
            cuts, n, share = feature_cuts(own, first["n"], self.params.bins)
        else:
            n, share = own.agg(F.count(F.lit(1)), F.avg("y")).first()
        share = min(max(share, 1e-6), 1 - 1e-6)
        base = float(np.log(share / (1 - share)))

        def block(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            return _packed(tuple(np.concatenate(x) for x in zip(*parts)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
                ids, y, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "held"))
                parts.append([binned(x, cuts), ids.astype(np.int64), y.astype(float), held.astype(bool), np.full(n, base)])
                size += n
                if size >= TASK_ROWS:
                    yield block(parts)
                    parts, size = [], 0
            if parts:
                yield block(parts)

        rows = own if held is None else own.unionByName(narrow(held, True))
        blocks = rows.mapInArrow(pack, _BLOCKS).repartition(-(-n // TASK_ROWS))
        table = write_table(blocks, "boost-rows")
        most = ONE_TASK_CELLS // len(cuts)
        few = n <= most and table.agg(F.sum(F.length("y"))).first()[0] <= 8 * most  # 8 bytes a row
        return Binned(table, cuts, base, self.params.bins, few)

    def fit(
        self, train: DataFrame, held: DataFrame | None = None, patience: int | None = None, ready: Binned | None = None
    ) -> BoostedTrees:
        """Grow up to ``rounds`` trees; with rows ``held`` out and a ``patience``, stop after so
        many rounds without a lower loss of theirs and keep the trees up to the lowest. ``ready``
        are the same rows binned before; they stay."""
        p = self.params
        if ready is not None and ready.bins != p.bins:
            raise ValueError(f"rows of {ready.bins} bins are no rows of {p.bins}")
        rows = ready or self.binned(train, held)
        run = _in_one_task if rows.one_task else _in_passes
        trees, gained, losses, at = run(rows, p, patience, held is not None)
        if ready is None:
            rows.drop()
        model = BoostedTrees(rows.cuts, rows.base, trees, [0.0] * len(rows.cuts), losses, len(trees))
        if patience is not None and at:
            model.trees = trees[:at]
        for gain in gained[: len(model.trees)]:
            for f, g in gain.items():
                model.gain[f] += g
        return model


def booster(label: str, seed: int, params: dict) -> HistogramBooster:
    return HistogramBooster(label, BoostParams(**{"seed": seed, **params}))


def params_of(model_params: BoostParams) -> dict:
    return asdict(model_params)
