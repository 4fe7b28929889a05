import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.bins import left_closed_bin, right_closed_bin, unit_bin
from tidemark.functions.columns import (
    day_of_week,
    hour_of_day,
    is_night,
    is_weekend,
    pick,
    plus_one_ratio,
    risk_score,
    row_mean,
    row_sum,
    with_row_std,
    safe_div,
    stable_hash,
    standardise,
)


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_time_parts(rows):
    df = rows([(0.0,), (3_599.0,), (3_600.0,), (86_399.0,), (5 * 86_400.0,), (-1.0,)], "t double")
    assert values(df, hour_of_day("t"), day_of_week("t")) == [(0, 0), (0, 0), (1, 0), (23, 0), (0, 5), (23, 6)]


def test_flags(rows):
    df = rows([(h,) for h in range(24)], "h int")
    night = [r[0] for r in values(df, is_night("h"))]
    assert night == [1] * 6 + [0] * 17 + [1]
    df = rows([(d,) for d in range(7)], "d int")
    assert [r[0] for r in values(df, is_weekend("d"))] == [0, 0, 0, 0, 0, 1, 1]


def test_division_by_zero_is_null(rows):
    df = rows([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert values(df, safe_div("a", "b")) == [(None,), (0.5,)]
    df = rows([(4.0, -1.0), (4.0, 1.0)], "a double, b double")
    assert values(df, plus_one_ratio("a", "b")) == [(None,), (2.0,)]


def test_row_families(rows):
    df = rows([(1.0, 2.0, 3.0), (1.0, None, None), (None, None, None), (1e9, 1e9 + 1, 1e9 + 2)], "V1 double, V2 double, V3 double")
    cols = ["V1", "V2", "V3"]
    got = values(with_row_std(df, cols, "std"), row_sum(cols), row_mean(cols), F.col("std"))
    assert got[0] == (6.0, 2.0, 1.0)
    assert got[1] == (1.0, 1.0, None)
    assert got[2] == (0.0, None, None)
    assert got[3][2] == pytest.approx(1.0)


def test_standardise_constant_column(rows):
    df = rows([(7.0,)], "x double")
    assert values(df, standardise("x", 7.0, 0.0)) == [(0.0,)]


def test_threshold_is_strict(rows):
    df = rows([(0.5,), (0.5000001,)], "prob double")
    assert values(df, pick(0.5)) == [(0,), (1,)]


def test_right_closed_bins_match_pandas(spark, rows):
    rng = np.random.default_rng(1)
    for x in (
        rng.uniform(-3, 9, 500),
        np.round(rng.uniform(0, 1, 500), 1),
        np.arange(0, 11, dtype=float),
        np.array([0.0, 5.0, 10.0]),
    ):
        for k in (2, 7, 10):
            df = rows([(float(v),) for v in x], "x double")
            low, high = float(x.min()), float(x.max())
            got = [r[0] for r in values(df, right_closed_bin("x", F.lit(low), F.lit(high), k))]
            assert got == pd.cut(x, k, labels=False).tolist()


def test_right_closed_bins_edges_and_constant(rows):
    df = rows([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert values(df, right_closed_bin("x", F.lit(0.0), F.lit(10.0), 10)) == [(0,), (4,), (9,), (None,)]
    df = rows([(7.0,)] * 3, "x double")
    assert values(df, right_closed_bin("x", F.lit(7.0), F.lit(7.0), 10)) == [(4,)] * 3


def test_left_closed_bins_match_numpy(rows):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=400), np.round(rng.uniform(0, 1, 400), 1), np.arange(0, 11, dtype=float)):
        for k in (3, 10, 20):
            df = rows([(float(v),) for v in x], "x double")
            bins = [r[0] for r in values(df, left_closed_bin("x", F.lit(float(x.min())), F.lit(float(x.max())), k))]
            assert np.bincount(bins, minlength=k).tolist() == np.histogram(x, bins=k)[0].tolist()


@pytest.mark.parametrize("k", [5, 10, 49])
def test_unit_bins_match_edges(rows, k):
    rng = np.random.default_rng(3)
    edges = np.linspace(0, 1, k + 1)
    p = np.concatenate([rng.uniform(size=300), edges, np.nextafter(edges, 2), [0.0, 1.0]])
    p = p[p <= 1.0]
    df = rows([(float(v),) for v in p], "p double")
    got = [r[0] for r in values(df, unit_bin("p", k))]
    assert got == np.searchsorted(edges, p, side="left").tolist()


def test_hash_is_stable_and_seeded(rows):
    df = rows([(i,) for i in range(2000)], "k bigint", 7)
    pdf = df.select("k", stable_hash("k", 1).alias("a"), stable_hash("k", 2).alias("b")).toPandas()
    assert (pdf.a != pdf.b).mean() > 0.99
    assert 0.45 < (pdf.a % 2).mean() < 0.55
    again = df.coalesce(1).select("k", stable_hash("k", 1).alias("a")).toPandas()
    assert dict(zip(pdf.k, pdf.a)) == dict(zip(again.k, again.a))


def test_risk_score_adds_up_and_is_clipped(rows):
    df = rows([(10.0, 12, "desktop", 1.0, 0.0), (200.0, 23, "mobile", 90.0, 100.0), (1.0, 12, "desktop", 1.0, 1e6)],
              "a double, h int, dev string, d double, t double")
    got = [r[0] for r in values(df, risk_score("a", "h", "dev", "d", "t", F.lit(100.0), F.lit(50.0)))]
    assert got[0] == pytest.approx(0.035)
    assert got[1] == pytest.approx(0.035 + 0.02 + 0.01 + 0.015 + 0.01 + 0.01)
    assert got[2] == 1.0


@pytest.mark.parametrize("width", [14, 15, 339])
def test_wide_families_plan_and_agree(rows, width):
    import statistics

    values = [[None if (i + r) % 4 == 0 else float((i * 7 + r) % 13) for i in range(width)] for r in range(3)] + [[None] * width]
    names = [f"V{i}" for i in range(width)]
    df = rows([tuple(v) for v in values], ", ".join(f"{n} double" for n in names))
    got = with_row_std(df, names, "d").select(row_sum(names).alias("s"), row_mean(names).alias("m"), "d").collect()
    for v, r in zip(values, got):
        own = [x for x in v if x is not None]
        assert r["s"] == sum(own)
        assert r["m"] == (pytest.approx(sum(own) / len(own)) if own else None)
        assert r["d"] == (pytest.approx(statistics.stdev(own)) if own else None)
