"""Boosted trees against a learner that counts every split on the driver, one leaf at a time."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import boosting as bo
from tidemark.operators.boosting import BoostedTrees, BoostParams, HistogramBooster

N, WIDTH = 2_000, 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, WIDTH))
    x[:, 1] = np.round(x[:, 1])  # few values, many ties
    x[:, 3] = 1.0  # says nothing
    x[::97, 2] = np.nan
    y = (rng.uniform(size=N) < 1 / (1 + np.exp(1 - 2 * x[:, 0] - x[:, 0] * x[:, 1]))).astype(int)
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"f{i} double" for i in range(WIDTH)) + ", y int")
    made = VectorAssembler(inputCols=[f"f{i}" for i in range(WIDTH)], outputCol="features", handleInvalid="keep").transform(df)
    return x, y, made.select("k", "y", "features").repartition(5).cache()


def ids_of(df):
    from pyspark.ml.functions import vector_to_array

    return {r.k: r.id for r in df.select("k", F.xxhash64("k", "y", vector_to_array("features")).alias("id")).collect()}


class Brute:
    """The same rules on whole arrays: no histograms, no subtraction, no speculation."""

    def __init__(self, x, y, ids, cuts, params):
        self.bins = np.stack([[int(np.sum(~(v <= c))) for v in x[:, f]] for f, c in enumerate(cuts)], axis=1)
        self.y, self.ids, self.cuts, self.p = y, ids, cuts, params

    def gain(self, rows, f, cut):
        p = self.p
        left, right = rows[self.bins[rows, f] <= cut], rows[self.bins[rows, f] > cut]

        def part(r):
            g, h = self.g[r].sum() / bo.SCALE, self.h[r].sum() / bo.SCALE + p.l2
            return g * g / h if h > 0 else 0.0

        if p.grow != "oblivious" and any(len(r) < p.min_rows or self.h[r].sum() < p.min_hessian * bo.SCALE for r in (left, right)):
            return -np.inf, left, right
        return part(left) + part(right) - part(rows), left, right

    def value(self, rows):
        h = self.h[rows].sum() / bo.SCALE + self.p.l2
        return -self.p.rate * (self.g[rows].sum() / bo.SCALE) / h if h > 0 else 0.0

    def tree(self, margin, round_):
        """{path: (feature, cut)} of the inner nodes, {path: value} of the leaves."""
        p = self.p
        self.g, self.h = bo.derivatives(margin, self.y)
        use = np.flatnonzero(bo.drawn(self.ids, p, round_))
        columns = bo.drawn_columns(len(self.cuts), p, round_)
        options = [(f, c) for f in columns for c in range(p.bins - 1)]
        inner, leaves = {}, {"": use}

        def best(path):
            if len(path) >= p.limit:
                return None
            found = [(self.gain(leaves[path], f, c)[0], -i) for i, (f, c) in enumerate(options)]
            gain, i = max(found)
            return (gain, *options[-i]) if gain > 1e-9 else None

        if p.grow == "oblivious":
            for depth in range(p.limit):
                sums = [(sum(self.gain(r, f, c)[0] for r in leaves.values()), -i) for i, (f, c) in enumerate(options)]
                gain, i = max(sums)
                if gain <= 1e-9:
                    break
                f, c = options[-i]
                for path in list(leaves):
                    rows = leaves.pop(path)
                    inner[path] = (f, c)
                    _, leaves[path + "0"], leaves[path + "1"] = self.gain(rows, f, c)
        else:
            most = p.leaves if p.grow == "leaf" else 2**p.limit
            splits = {"": best("")}
            while len(leaves) < most:
                open_ = sorted((-s[0], len(path), path) for path, s in splits.items() if s)
                if not open_:
                    break
                path = open_[0][2]
                _, f, c = splits.pop(path)
                rows = leaves.pop(path)
                inner[path] = (f, c)
                _, leaves[path + "0"], leaves[path + "1"] = self.gain(rows, f, c)
                for side in "01":
                    splits[path + side] = best(path + side)
        return inner, {path: self.value(rows) for path, rows in leaves.items()}


def as_paths(tree):
    inner, leaves, stack = {}, {}, [(0, "")]
    while stack:
        node, path = stack.pop()
        if tree.feature[node] < 0:
            leaves[path] = tree.value[node]
        else:
            inner[path] = (tree.feature[node], tree.cut[node])
            stack += [(tree.left[node], path + "0"), (tree.left[node] + 1, path + "1")]
    return inner, leaves


@pytest.mark.parametrize(
    "params",
    [
        BoostParams(grow="leaf", rounds=3, leaves=9, bins=8, rate=0.3),
        BoostParams(grow="leaf", rounds=5, leaves=31, bins=6, rate=0.2, row_share=0.6, row_every=2, column_share=0.5, min_rows=5, l2=1.0, refresh=2),
        BoostParams(grow="depth", rounds=2, depth=3, bins=8, min_rows=1, l2=1.0, min_hessian=1.0, row_share=0.8),
        BoostParams(grow="oblivious", rounds=3, depth=3, bins=8, l2=3.0, row_share=0.8, refresh=1),
    ],
    ids=lambda p: f"{p.grow}-{p.rounds}",
)
def test_trees_equal_brute_force(data, params, monkeypatch):
    x, y, df = data
    if params.grow != "leaf":
        monkeypatch.setattr(bo, "FEW_TASKS", 0)  # histograms summed by a tree of tasks
        monkeypatch.setattr(bo, "TASK_ROWS", 300)
    model = HistogramBooster("y", params).fit(df)
    known = ids_of(df)
    brute = Brute(x, y, np.array([known[i] for i in range(N)]), model.cuts, params)
    margin = np.full(N, model.base)
    assert len(model.trees) == params.rounds
    for round_, tree in enumerate(model.trees):
        inner, leaves = brute.tree(margin, round_)
        got_inner, got_leaves = as_paths(tree)
        assert got_inner == inner and got_leaves == pytest.approx(leaves, abs=1e-12)
        assert not params.grow == "leaf" or len(leaves) <= params.leaves
        margin += tree.value[tree.leaf_of(brute.bins)]
    assert model.margins(x) == pytest.approx(margin, abs=1e-12)


def test_early_stopping_grows_nothing_twice(data):
    x, y, df = data
    params = BoostParams(grow="leaf", rounds=60, leaves=31, rate=0.5, min_rows=5, refresh=4)
    train, held = df.where("k < 1200"), df.where("k >= 1200")
    model = HistogramBooster("y", params).fit(train, held, patience=4)
    assert 0 < model.best_round < 56 and model.grown == model.best_round + 4 == len(model.losses)
    assert model.losses.index(min(model.losses)) + 1 == model.best_round
    # The kept trees are the first ones of a run without a stop, and the losses those of its prefixes.
    full = HistogramBooster("y", BoostParams(**{**bo.params_of(params), "rounds": model.grown})).fit(train)
    for a, b in zip(model.trees, full.trees):
        assert as_paths(a) == as_paths(b)
    margin = np.full(N - 1200, full.base)
    bins = bo.binned(x[1200:], full.cuts)
    for tree, loss in zip(full.trees, model.losses):
        tree.add_to(margin, bins)
        assert np.mean(np.logaddexp(0, margin) - y[1200:] * margin) == pytest.approx(loss, abs=1e-5)


def test_scores_importances_and_persistence(spark, data, tmp_path):
    x, y, df = data
    model = HistogramBooster("y", BoostParams(rounds=6, leaves=7, rate=0.3)).fit(df, df, None)
    assert model.grown == 6 == len(model.losses) and model.losses == sorted(model.losses, reverse=True)
    assert sum(model.featureImportances) == pytest.approx(1.0) and model.featureImportances[3] == 0.0
    assert np.argmax(model.featureImportances) == 0
    model.save(f"{tmp_path}/m")
    again = BoostedTrees.load(spark, f"{tmp_path}/m")
    got = {r.k: r.p for r in again.score(df, "p").select("k", "p").collect()}
    assert [got[i] for i in range(N)] == pytest.approx(list(1 / (1 + np.exp(-model.margins(x)))), abs=1e-15)


def test_fit_does_not_depend_on_partitions(data):
    _, _, df = data
    params = BoostParams(rounds=2, leaves=5, row_share=0.7)
    a, b = (HistogramBooster("y", params).fit(part) for part in (df, df.repartition(1)))
    for s, t in zip(a.trees, b.trees):
        assert as_paths(s) == as_paths(t)


def test_odd_tables(spark, data):
    _, _, df = data
    one = HistogramBooster("y", BoostParams(rounds=2)).fit(df.where("y = 1"))
    assert all(len(t.feature) == 1 for t in one.trees)
    none = df.select("k", F.lit(None).cast("int").alias("y"), "features")
    with pytest.raises(ValueError, match="no labelled rows"):
        HistogramBooster("y", BoostParams()).fit(none)
    for bad in ({"grow": "wide"}, {"bins": 1}, {"rounds": 0}, {"leaves": 1}):
        with pytest.raises(ValueError):
            BoostParams(**bad)


def test_a_pass_looks_only_at_the_way_to_the_asked_nodes():
    rng = np.random.default_rng(2)
    n = bo.COUNT_ROWS + 5_000  # more rows than one exact sum takes
    bins = np.asfortranarray(rng.integers(0, 8, (n, 3)).astype(np.uint8))
    tree = bo.Tree(*(np.array(x) for x in ([0, 1, -1, -1, 2, -1, -1], [3, 5, 0, 0, 1, 0, 0], [1, 3, -1, -1, 5, -1, -1])), np.zeros(7))
    leaf = [2 if r[0] > 3 else 3 if r[1] <= 5 else 5 if r[2] <= 1 else 6 for r in bins.tolist()]
    assert tree.leaf_of(bins).tolist() == leaf
    rows = np.arange(0, n, 3)
    found = {node: own.tolist() for node, own in tree.rows_at(bins, rows, [6, 3])}
    assert found == {k: [i for i in rows.tolist() if leaf[i] == k] for k in (3, 6)}

    class Parts:
        def __init__(self, blocks):
            self.blocks = blocks

        def mapPartitions(self, run):  # noqa: N802  as Spark's
            return Parts(list(run(iter(self.blocks))))

        def collect(self):
            return self.blocks

    y, margin, held = rng.integers(0, 2, n).astype(float), rng.normal(size=n), rng.random(n) < 0.1
    blocks = Parts([(bins, np.arange(n), y, held, margin)])
    hist, _ = bo._histograms(blocks, 1, BoostParams(bins=8), 0, tree, [6, 2], np.array([0, 2]))
    g, h = bo.derivatives(margin, y)
    want = np.zeros((2, 2, 8, 3), np.int64)
    for slot, node in enumerate((6, 2)):
        own = np.flatnonzero((np.array(leaf) == node) & ~held)
        for j, f in enumerate((0, 2)):
            for k, weight in enumerate((g, h, np.ones(n))):
                np.add.at(want[slot, j, :, k], bins[own, f], weight[own].astype(np.int64))
    assert (hist == want).all()
    assert bo._histograms(blocks, 1, BoostParams(bins=8), 0, tree, [6], np.array([0]), False)[1] is None


def test_learners_share_binned_rows(data, monkeypatch):
    _, _, df = data
    train, held = df.where("k < 1200"), df.where("k >= 1200")
    settings = [BoostParams(grow="leaf", rounds=3, leaves=5, refresh=2), BoostParams(grow="oblivious", rounds=2, depth=2, row_share=0.7)]
    alone = [HistogramBooster("y", p).fit(train, held, 2) for p in settings]
    ready = HistogramBooster("y", settings[0]).binned(train, held)
    monkeypatch.setattr(bo, "feature_cuts", None)  # nothing is binned again
    together = [HistogramBooster("y", p).fit(train, held, 2, ready) for p in settings]
    again = HistogramBooster("y", settings[0]).binned(train, held, ready.cuts)
    assert again.base == ready.base and again.table.count() == ready.table.count() > 0  # a fit leaves them
    for a, b in zip(alone, together):
        assert a.losses == b.losses and a.cuts[0].tolist() == b.cuts[0].tolist()
        assert [as_paths(t) for t in a.trees] == [as_paths(t) for t in b.trees]
    with pytest.raises(ValueError, match="bins"):
        HistogramBooster("y", BoostParams(bins=8)).fit(train, held, 2, ready)


@pytest.mark.parametrize(
    "params",
    [
        BoostParams(grow="leaf", rounds=40, leaves=12, rate=0.4, min_rows=5, row_share=0.7, row_every=3, column_share=0.6, refresh=4),
        BoostParams(grow="depth", rounds=7, depth=4, rate=0.3, min_rows=1, l2=1.0, row_share=0.8, refresh=3),
        BoostParams(grow="oblivious", rounds=7, depth=3, l2=3.0, refresh=3),
    ],
    ids=lambda p: p.grow,
)
def test_one_task_grows_what_passes_grow(data, params, monkeypatch):
    _, _, df = data
    monkeypatch.setattr(bo, "TASK_ROWS", 300)
    train, held = df.where("k < 1200"), df.where("k >= 1200")
    ran = []
    for name in ("_in_one_task", "_in_passes"):
        own = getattr(bo, name)
        monkeypatch.setattr(bo, name, lambda *args, own=own, name=name: ran.append(name) or own(*args))
    near = HistogramBooster("y", params).fit(train, held, 5)
    # The limit counts the rows held out too: 2,000 in all.
    monkeypatch.setattr(bo, "ONE_TASK_CELLS", 1_999 * WIDTH)
    spread = HistogramBooster("y", params).fit(train, held, 5)
    assert ran == ["_in_one_task", "_in_passes"] and near.grown == spread.grown >= 6
    assert near.losses == spread.losses and near.gain == spread.gain and near.best_round == spread.best_round
    for a, b in zip(near.trees, spread.trees):
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("feature", "cut", "left", "value"))


def test_sums_of_a_task_are_exact_over_many_chunks():
    rng = np.random.default_rng(4)
    n, params = 2 * bo.CELL_ROWS + 77, BoostParams(bins=8)
    bins = np.asfortranarray(rng.integers(0, 8, (n, 3)).astype(np.uint8))
    y, margin, held = rng.integers(0, 2, n).astype(float), rng.normal(size=n), rng.random(n) < 0.1
    tree = bo.Tree(*(np.array(x) for x in ([1, -1, -1], [4, 0, 0], [1, -1, -1])), np.zeros(3))
    near = bo._Near([(bins[:5], np.arange(5), y[:5], held[:5], margin[:5]), (bins[5:], np.arange(5, n), y[5:], held[5:], margin[5:])], params)
    hist, loss = near.count(0, tree, [2, 1], np.array([0, 2]), True)
    g, h = bo.derivatives(margin, y)
    want = np.zeros((2, 2, 8, 3), np.int64)
    for slot, side in enumerate((bins[:, 1] > 4, bins[:, 1] <= 4)):
        own = np.flatnonzero(side & ~held)
        for j, f in enumerate((0, 2)):
            for k, weight in enumerate((g, h, np.ones(n))):
                np.add.at(want[slot, j, :, k], bins[own, f], weight[own].astype(np.int64))
    assert (hist == want).all() and loss == int(bo.losses(margin[held], y[held]).sum()) / bo.SCALE / held.sum()
