import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import order
from tidemark.operators.order import (
    RankRequest,
    bucket_bounds,
    cut_points,
    order_statistics,
    row_index,
    running_totals,
)
from tidemark.operators.quantiles import exact_quantiles, ordered_bits, value_of, values_at_ranks


def shapes():
    rng = np.random.default_rng(5)
    n = 3_000
    hot = np.where(rng.uniform(size=n) < 0.4, 3.25, rng.normal(size=n))
    return {
        "uniform": rng.uniform(size=n),
        "skewed": rng.lognormal(0, 4, n),
        "hot_value": hot,
        "few_values": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, 7.0),
    }


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("candidates", [10, 200_000])
def test_order_statistics_are_exact(rows, name, candidates):
    x = shapes()[name]
    df = rows([(float(v),) for v in x], "x double", 4)
    ranks = [1, 2, 750, 1499, 1500, 1501, 2999, 3000]
    got = order_statistics(df, {"x": RankRequest(F.col("x"), lambda n: ranks)}, candidates)["x"]
    s = np.sort(x)
    for g in got:
        v = s[g.rank - 1]
        assert (g.value, g.below, g.equal, g.n) == (v, (x < v).sum(), (x == v).sum(), len(x))


def test_ranks_at_the_edge_of_a_hot_value(rows):
    """Two thirds of the rows hold one value; ranks right beside it need it cut off."""
    n, hot = 30_000, 20_000
    data = [(-1.0 - i / n,) for i in range(5_000)] + [(0.0,)] * hot + [(1.0 + i / n,) for i in range(5_000)]
    df = rows(data, "x double", 6)
    ranks = [1, 4_999, 5_000, 5_001, 25_000, 25_001, 25_002, 30_000]
    got = order_statistics(df, {"x": RankRequest(F.col("x"), lambda k: ranks)}, 20)["x"]
    s = np.sort([d[0] for d in data])
    assert [g.value for g in got] == [s[r - 1] for r in ranks]
    assert got[3].below == 5_000 and got[3].equal == hot


@pytest.mark.parametrize("per_step", [1, 50])
def test_sampled_grids_never_change_the_result(spark, monkeypatch, per_step):
    """With a hopelessly small sample the brackets miss and are drawn again."""
    monkeypatch.setattr(order, "_SAMPLE", 1)
    monkeypatch.setattr(order, "_PER_STEP", per_step)
    df = spark.range(0, 60_000, 1, 6).select(F.pmod(F.col("id") * 7_919, F.lit(60_000)).alias("x"))
    ranks = [1, 2, 29_999, 30_000, 59_000, 60_000]
    got = order_statistics(df, {"x": RankRequest(F.col("x"), lambda n: ranks)}, 100)["x"]
    assert [(g.value, g.below, g.equal) for g in got] == [(r - 1, r - 1, 1) for r in ranks]


def test_integers_beyond_double_precision(rows):
    base = 2**53
    x = [base + i for i in range(100)]
    df = rows([(v,) for v in x], "x bigint", 3)
    for candidates in (5, 200_000):
        got = order_statistics(df, {"x": RankRequest(F.col("x"), lambda n: [1, 50, 51, 100])}, candidates)["x"]
        assert [g.value for g in got] == [base, base + 49, base + 50, base + 99]


def test_rank_out_of_range_is_an_error(rows):
    df = rows([(1.0,)], "x double")
    with pytest.raises(ValueError):
        order_statistics(df, {"x": RankRequest(F.col("x"), lambda n: [2])})


def test_quantiles_match_pandas(rows):
    x = shapes()["skewed"]
    data = [(float(v), None if i % 3 else float(i)) for i, v in enumerate(x)]
    df = rows(data, "a double, b double", 5)
    pdf = pd.DataFrame(data, columns=["a", "b"])
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, probs)
    for c in ("a", "b"):
        assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist())


@pytest.mark.parametrize("name", list(shapes()))
def test_values_at_ranks_are_exact(rows, name):
    x = shapes()[name]
    ranks = [1, 2, 77, len(x) // 2, len(x)]
    n, got = values_at_ranks(rows([(float(v),) for v in x], "x double", 7), {"x": F.col("x")}, lambda n: ranks)["x"]
    assert n == len(x) and got == [np.sort(x)[r - 1] for r in ranks]


def test_words_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1, 2), np.inf])
    words = ordered_bits(x)
    assert (np.diff(words.astype(object)) >= 0).all() and words[4] == words[5]
    assert [value_of(int(w), False) for w in words] == x.tolist()
    i = np.array([-(2**63), -1, 0, 2**53 + 1, 2**63 - 1])
    assert [value_of(int(w), True) for w in ordered_bits(i)] == i.tolist()


def test_four_hundred_columns_in_one_plan(rows):
    rng = np.random.default_rng(8)
    x = np.round(rng.lognormal(0, 3, size=(60, 400)), 3)
    x[:, 7] = 2**53  # one value
    big = [int(v) for v in 2**60 + rng.permutation(60)]
    data = [(*map(float, r), b, None if i % 2 else float(i)) for i, (r, b) in enumerate(zip(x, big))]
    df = rows(data, ", ".join(f"c{i} double" for i in range(400)) + ", big long, half double", 3)
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5, 0.75])
    want = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for i in range(400):
        assert got[f"c{i}"] == pytest.approx(want[:, i].tolist(), rel=1e-12)
    assert got["half"] == [14.5, 29.0, 43.5]
    ranked = values_at_ranks(df, {"big": F.col("big")}, lambda n: [1, 30, 60])["big"]
    assert ranked == (60, [sorted(big)[r - 1] for r in (1, 30, 60)])
    assert values_at_ranks(df, {}, lambda n: [1]) == {}
    with pytest.raises(ValueError, match="outside"):
        values_at_ranks(df, {"c0": F.col("c0")}, lambda n: [61])


def test_even_median_and_all_null(rows):
    df = rows([(1.0, None), (2.0, None), (3.0, None), (4.0, None)], "a double, b double")
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert got == {"a": [2.5], "b": [None]}


@pytest.mark.parametrize("candidates", [5, 200_000])
@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_cuts_inside_ties(rows, candidates, partitions):
    rng = np.random.default_rng(8)
    data = [(int(k), float(t)) for k, t in zip(rng.permutation(1_000), rng.integers(0, 4, 1_000))]
    df = rows(data, "k bigint, t double", partitions)
    ranks = [0, 1, 137, 500, 999, 1000]
    cuts = cut_points(df, "t", "k", lambda n: ranks, candidates=candidates)["all"]
    expected = sorted(data, key=lambda r: (r[1], r[0]))
    for rank, cut in zip(ranks, cuts):
        got = {r["k"] for r in df.where(cut.holds(F.col("t"), F.col("k"))).collect()}
        assert got == {k for k, _ in expected[:rank]}


def test_null_times_sort_last(rows):
    df = rows([(1, 5.0), (2, None), (3, 1.0), (4, None), (5, None)], "k bigint, t double")
    cuts = cut_points(df, "t", "k", lambda n: [1, 2, 3, 4, 5])["all"]
    got = [sorted(r["k"] for r in df.where(c.holds(F.col("t"), F.col("k"))).collect()) for c in cuts]
    assert got == [[3], [1, 3], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5]]


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_row_index_matches_single_task_order(rows, partitions):
    rng = np.random.default_rng(9)
    data = [(int(k), float(t), ["a", "b", None][g]) for k, t, g in zip(rng.permutation(2_000), rng.integers(0, 9, 2_000), rng.integers(0, 3, 2_000))]
    df = rows(data, "k bigint, t double, g string", partitions)
    got = {r["k"]: r["position"] for r in row_index(df, ["t", "k"]).collect()}
    for i, (k, _, _) in enumerate(sorted(data, key=lambda r: (r[1], r[0])), 1):
        assert got[k] == i
    got = {r["k"]: r["position"] for r in row_index(df, ["t", "k"], ["g"]).collect()}
    assert len(got) == len(data)
    for g in ("a", "b", None):
        for i, (k, _, _) in enumerate(sorted((r for r in data if r[2] == g), key=lambda r: (r[1], r[0])), 1):
            assert got[k] == i


def test_row_index_with_counted_offsets_too_large_to_broadcast(rows, monkeypatch):
    monkeypatch.setattr(order, "BROADCAST_BYTES", -1)
    df = rows([(i, i % 7) for i in range(500)], "k bigint, g int", 5)
    got = row_index(df, ["k"], ["g"]).collect()
    assert all(r["position"] == r["k"] // 7 + 1 for r in got)


@pytest.mark.parametrize("rows_per_bucket", [20, 10**6])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(rows, rows_per_bucket, descending):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 900), "s": rng.permutation(900) / 900.0, "a": rng.integers(0, 9, 900).astype(float)})
    df = rows([tuple(map(float, r)) for r in pdf.values], "g double, s double, a double", 6)
    df = df.withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    bounds = bucket_bounds(df, "s", rows_per_bucket)
    assert bool(bounds) == (rows_per_bucket == 20)
    got = running_totals(df, ["g"], "s", ["a"], bounds, descending, following=True).toPandas()
    pdf = pdf.sort_values("s", ascending=not descending)
    pdf["cum_a"] = pdf.groupby("g").a.cumsum()
    pdf["all_a"] = pdf.groupby("g").a.transform("sum")
    pdf["next_a"] = pdf.groupby("g").a.shift(-1)
    pdf = pdf.sort_values("s")
    got = got.sort_values("s")
    for c in ("cum_a", "all_a", "next_a"):
        np.testing.assert_allclose(got[c].values.astype(float), pdf[c].values)


def test_order_plans_do_not_gather_rows(spark, transactions):
    """A split is a projection: no exchange of the rows between scan and label."""
    from tidemark.operators.splits import temporal_split

    split = temporal_split(spark.range(1000).selectExpr("id as k", "id * 2 as t"), "t", "k")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_nan_is_missing(rows):
    data = [(float(i),) for i in range(1000)] + [(float("nan"),)] * 3
    assert exact_quantiles(rows(data, "x double", 4), {"x": F.col("x")}, [0.25, 0.5, 0.75])["x"] == [249.75, 499.5, 749.25]
    assert exact_quantiles(rows([(float("nan"),)], "x double"), {"x": F.col("x")}, [0.5])["x"] == [None]


@pytest.mark.parametrize("kind", ["string", "decimal(38,5)", "date", "bigint", "double"])
@pytest.mark.parametrize("time", ["timestamp", "timestamp_ntz", "date", "double", "int"])
def test_periods_over_any_key_and_time(rows, kind, time):
    from tidemark.operators.splits import drift_periods

    t = {"double": F.col("i") % 3 + 0.5, "int": (F.col("i") % 3).cast("int")}.get(time)
    if t is None:
        t = F.timestamp_seconds(F.col("i") % 3 * 90_000).cast(time)
    key = {
        "string": F.concat(F.lit("shared-prefix-"), F.lpad(F.col("i").cast("string"), 3, "0")),
        "decimal(38,5)": F.lit("123456789012345678901234567890").cast(kind) + (F.col("i") / 1000).cast("decimal(8,5)"),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("i").cast("int")),
    }.get(kind, F.col("i").cast(kind))
    df = rows([(i,) for i in range(90)], "i bigint", 4).select("i", t.alias("t"), key.cast(kind).alias("k"))
    got = {r["i"]: r["period"] for r in drift_periods(df, "t", "k", 4, candidates=7).collect()}
    order = sorted(range(90), key=lambda i: (i % 3, i))
    assert got == {i: min(at // 22, 3) for at, i in enumerate(order)}


def test_repeated_keys_give_exact_sizes(rows):
    from collections import Counter

    from tidemark.operators.splits import drift_periods

    df = rows([(float(i // 40), i // 10, i) for i in range(100)], "t double, k bigint, other int", 4)
    sizes = Counter(r["period"] for r in drift_periods(df, "t", "k", 4).collect())
    assert sizes == {0: 25, 1: 25, 2: 25, 3: 25}
