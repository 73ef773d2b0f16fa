"""Ranks among all earlier steps: slices and buckets against a plain count, with hot values and odd rows."""

import random

import numpy as np
import pytest

from noveltybench.operators import past


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 101])
def test_counts_of_a_sequence(n):
    rng = np.random.default_rng(n)
    v, w = rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n)
    assert past.earlier_greater(v, w).tolist() == [int(w[:i][v[:i] > v[i]].sum()) for i in range(n)]
    assert past.earlier_equal(v, w).tolist() == [int(w[:i][v[:i] == v[i]].sum()) for i in range(n)]


def series(seed=3):
    rnd = random.Random(seed)
    rows = [(1, t, rnd.choice([0.0, 0.0, 0.0, rnd.random(), rnd.randint(0, 5) * 1.0])) for t in range(230)]
    rows += [(2, t, 4.0) for t in range(90)] + [(3, 0, 1.0), (4, 5, float("inf")), (4, 7, float("-inf")), (4, 9, 2.0)]
    return rows


def plain(rows):
    want = set()
    for e, t, x in rows:
        before = [v for f, s, v in rows if f == e and s < t]
        want.add((e, t, x, len(before), sum(v > x for v in before), before.count(x)))
    return want


@pytest.mark.parametrize("slice_rows", [1_000, 100, 9])
def test_slices_equal_a_plain_count(spark, slice_rows):
    rows = series()
    odd = [(None, 1, 1.0), (1, None, 1.0), (1, 500, None), (1, 501, float("nan"))]
    df = spark.createDataFrame(rows + odd, "entity long, t int, v double")
    got = past.past_ranks(df, "v", slice_rows).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == plain(rows)


def test_slices_stay_bounded_and_repeated_times_are_steps(spark, monkeypatch):
    """A series of more slices than allowed takes longer ones; rows that repeat a time follow by value."""
    monkeypatch.setattr(past, "SLICES", 4)
    df = spark.createDataFrame([(1, t // 2, float(t % 5)) for t in range(60)], "entity long, t int, v double")
    ordered = sorted((t // 2, float(t % 5)) for t in range(60))
    want = {(1, t, x, i, sum(v > x for _, v in ordered[:i]), sum(v == x for _, v in ordered[:i])) for i, (t, x) in enumerate(ordered)}
    assert {tuple(r) for r in past.past_ranks(df, "v", 5).collect()} == want


def test_no_steps(spark):
    assert past.past_ranks(spark.createDataFrame([], "entity long, t int, v double"), "v").collect() == []
