import pytest

from tidemark.operators.splits import (
    drift_periods,
    half_split,
    random_holdout,
    sample_rows,
    stratified_folds,
    stratified_temporal_split,
    temporal_split,
)


def counts(df, *cols):
    return {tuple(r)[:-1] if len(cols) > 1 else r[0]: r["count"] for r in df.groupBy(*cols).count().collect()}


@pytest.fixture
def timed(rows):
    return rows([(i, float((i * 37) % 101), i % 5 == 0) for i in range(101)], "k bigint, t double, y boolean", 4).selectExpr(
        "k", "t", "cast(y as int) as y"
    )


def test_temporal_sizes_and_order(timed):
    df = temporal_split(timed, "t", "k", (0.7, 0.15, 0.15))
    assert counts(df, "split") == {"train": 70, "val": 15, "test": 16}
    last = {r["split"]: (r["lo"], r["hi"]) for r in df.groupBy("split").agg({"t": "min"}).withColumnRenamed("min(t)", "lo").join(
        df.groupBy("split").agg({"t": "max"}).withColumnRenamed("max(t)", "hi"), "split").collect()}
    assert last["train"][1] < last["val"][0] and last["val"][1] < last["test"][0]


def test_ratios_must_sum_to_one(timed):
    with pytest.raises(ValueError):
        temporal_split(timed, "t", "k", (0.5, 0.3, 0.3))


@pytest.mark.parametrize(
    "n,k,sizes",
    [(11, 5, {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}), (3, 5, {4: 3}), (5, 2, {0: 2, 1: 3}), (4, 1, {0: 4})],
)
def test_period_sizes(rows, n, k, sizes):
    df = rows([(i, float(i)) for i in range(n)], "k bigint, t double")
    assert counts(drift_periods(df, "t", "k", k), "period") == sizes


def test_tied_times_follow_the_key(rows):
    df = rows([(4, 1.0), (2, 1.0), (3, 1.0), (1, 1.0)], "k bigint, t double")
    got = {r["k"]: r["period"] for r in drift_periods(df, "t", "k", 2).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_stratified_split_keeps_class_shares(timed, rows):
    df = stratified_temporal_split(timed, "t", "k", "y", 0.8)
    assert counts(df, "y", "split") == {(0, "train"): 64, (0, "test"): 16, (1, "train"): 16, (1, "test"): 5}
    odd = rows([(1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 2), (4, 4.0, None)], "k bigint, t double, y int")
    assert stratified_temporal_split(odd, "t", "k", "y", 0.5).count() == 2


def test_half_split(timed):
    assert counts(half_split(timed, "t", "k"), "domain") == {0: 50, 1: 51}


@pytest.mark.parametrize("partitions", [1, 9])
def test_random_splits_do_not_depend_on_partitions(timed, partitions):
    a = {r["k"]: r["holdout"] for r in random_holdout(timed.repartition(partitions), "k", 0.3, 7).collect()}
    b = {r["k"]: r["holdout"] for r in random_holdout(timed, "k", 0.3, 7).collect()}
    assert a == b and 15 < sum(a.values()) < 46
    c = {r["k"] for r in sample_rows(timed.repartition(partitions), "k", 10, 7).collect()}
    assert c == {r["k"] for r in sample_rows(timed, "k", 10, 7).collect()} and len(c) == 10
    assert sample_rows(timed, "k", 10_000).count() == 101


def test_folds_share_each_class(timed):
    got = counts(stratified_folds(timed, "y", "k", 3), "y", "fold")
    assert {f: got[0, f] for f in range(3)} == {0: 26, 1: 27, 2: 27}
    assert {f: got[1, f] for f in range(3)} == {0: 7, 1: 7, 2: 7}
