"""Quantiles of large groups: exact, and without ranking all their values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltybench.operators import ranks


@pytest.fixture
def cells(spark):
    """One large group with many values, one with few, a small one, and rows without a key or a value."""
    n = 30_000
    many = spark.range(n).select(F.lit("many").alias("k"), (F.col("id") * 7_919 % n * 0.5).alias("v"))
    few = spark.range(n).select(F.lit("few").alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("double")).alias("v"))
    rest = spark.createDataFrame([("small", 1.0), ("small", 4.0), (None, 9.0)], "k string, v double")
    return many.unionByName(few).unionByName(rest)


WANT = {"many": float(np.quantile(np.arange(30_000) * 0.5, 0.3)), "few": 1.0, "small": 1.9}


def answers(cells):
    return {r["k"]: r["q"] for r in ranks.quantile(cells, ["k"], "v", 0.3, "q").collect()}


def test_large_groups_are_narrowed(cells, monkeypatch):
    """No window ranks more values than a bucket holds."""
    monkeypatch.setattr(ranks, "PER_BUCKET", 1_000)
    ranked, whole = [], ranks.running
    monkeypatch.setattr(ranks, "running", lambda levels, *more: ranked.append(levels.count()) or whole(levels, *more))
    assert answers(cells) == pytest.approx(WANT)
    assert max(ranked, default=0) <= 1_000


@pytest.mark.parametrize("off", [-8_000.0, 8_000.0])
def test_brackets_that_miss(cells, monkeypatch, off):
    """A bracket that does not hold the quantile changes no answer."""
    monkeypatch.setattr(ranks, "PER_BUCKET", 1_000)
    right = ranks.brackets
    monkeypatch.setattr(ranks, "brackets", lambda *a: right(*a).withColumns({c: F.col(c) + off for c in ("__from", "__to")}))
    assert answers(cells) == pytest.approx(WANT)


def test_without_keys(cells, monkeypatch):
    monkeypatch.setattr(ranks, "PER_BUCKET", 1_000)
    found = ranks.quantile(cells.where("k = 'many'"), [], "v", 0.3, "q").collect()
    assert [r["q"] for r in found] == pytest.approx([WANT["many"]])


def test_uneven_groups_share_no_cuts(spark):
    """Only a group that needs buckets is cut; the sums are those of one window."""
    levels = spark.range(5_000).select(F.when(F.col("id") < 4_990, "a").otherwise("b").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    got = {(r["k"], r["v"]): r["n_before"] for r in ranks.running(levels, ["k"], "v", ["n"], 9).collect()}
    assert got == {("a" if i < 4_990 else "b", float(i)): i if i < 4_990 else i - 4_990 for i in range(5_000)}
