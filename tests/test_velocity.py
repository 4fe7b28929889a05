import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.velocity import hot_cards, time_since_previous, with_velocity


def expected(data):
    pdf = pd.DataFrame(data, columns=["k", "card", "t"]).sort_values(["card", "t", "k"])
    pdf["d"] = pdf.groupby("card").t.diff()
    return {int(k): None if np.isnan(d) else d for k, d in zip(pdf.k, pdf.d)}


def collected(df):
    return {r["k"]: r["time_diff"] for r in df.collect()}


def test_first_row_and_gap(rows):
    df = rows([(1, 7, 0.0), (2, 7, 9.0), (3, 8, 5.0)], "k bigint, card int, t double")
    got = {r["k"]: r["velocity"] for r in with_velocity(df, "card", "t", "k").collect()}
    assert got == {1: None, 2: 0.1, 3: None}


@pytest.mark.parametrize("hot_rows", [30, 10**7])
@pytest.mark.parametrize("times", ["spread", "tied", "one_time"])
@pytest.mark.parametrize("partitions", [1, 16])
def test_hot_cards_match_the_plain_window(rows, hot_rows, times, partitions):
    rng = np.random.default_rng(4)
    n = 1_200
    card = np.where(rng.uniform(size=n) < 0.4, 1, rng.integers(2, 60, n))
    t = {
        "spread": rng.uniform(0, 1e6, n),
        "tied": rng.integers(0, 5, n).astype(float),
        "one_time": np.where(rng.uniform(size=n) < 0.8, 42.0, rng.uniform(0, 100, n)),
    }[times]
    data = [(int(k), int(c), float(x)) for k, c, x in zip(rng.permutation(n), card, t)]
    df = rows(data, "k bigint, card int, t double", partitions)
    assert (1 in {r["card"] for r in hot_cards(df, "card", hot_rows).collect()}) == (hot_rows == 30)
    assert collected(time_since_previous(df, "card", "t", "k", hot_rows=hot_rows)) == expected(data)


def test_rows_without_card_have_no_velocity(rows):
    df = rows([(1, None, 0.0), (2, None, 9.0), (3, 8, 5.0), (4, 8, 6.0)], "k bigint, card int, t double")
    for hot_rows in (1, 10**7):
        got = {r["k"]: r["velocity"] for r in with_velocity(df, "card", "t", "k", hot_rows=hot_rows).collect()}
        assert got == {1: None, 2: None, 3: None, 4: 0.5}


def test_chunks_bound_the_window_groups(rows):
    """With one card holding everything, no window group keeps more than a few chunks' rows."""
    data = [(i, 1, float(i % 3)) for i in range(3_000)]
    df = rows(data, "k bigint, card int, t double", 4)
    out = time_since_previous(df, "card", "t", "k", hot_rows=200)
    assert collected(out) == expected(data)
    assert out.agg(F.count_if(F.col("time_diff").isNull())).first()[0] == 1


def test_rows_without_card_do_not_gather(rows):
    df = rows([(i, None if i % 2 else 1, float(i)) for i in range(400)], "k bigint, card int, t double", 4)
    for hot_rows in (50, 10**7):
        out = time_since_previous(df, "card", "t", "k", hot_rows=hot_rows)
        got = collected(out)
        assert all(got[i] is None for i in range(1, 400, 2))
        assert [got[i] for i in range(2, 400, 2)] == [2.0] * 199


def test_long_card_names_are_not_broadcast(rows, monkeypatch):
    from tidemark.operators import velocity

    data = [(i, f"{i % 3}" * 200, float(i)) for i in range(300)]
    df = rows(data, "k bigint, card string, t double", 4)
    monkeypatch.setattr(velocity, "BROADCAST_BYTES", 500)
    got = collected(time_since_previous(df, "card", "t", "k", hot_rows=50))
    assert got == {i: 3.0 if i > 2 else None for i in range(300)}
