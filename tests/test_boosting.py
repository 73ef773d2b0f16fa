"""Boosted trees: against a plain recursion over thresholds, by Spark passes and without, odd rows."""

import numpy as np

from noveltybench.operators import boosting

SCHEMA = "vec_id long, x array<double>, y int"


def drawn(seed, n, d):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)  # few values, so that cuts tie
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0.3) ^ (rng.random(n) < 0.05)).astype(int)
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], SCHEMA)


def scores_of(df):
    return [r["score"] for r in df.orderBy("vec_id").collect()]


def plain(x, y, cuts, depth, rounds, rate):
    """Margins by a recursion that tries every cut of every entry."""

    def grow(rows, level, g, h, out):
        best = (1e-9, None)
        for i, c in enumerate(cuts):
            for v in c:
                left = x[rows, i] <= v
                sums = [(g[rows[m]].sum(), h[rows[m]].sum()) for m in (left, ~left)]
                gain = sum(a**2 / (b + 1) for a, b in sums) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                if min(b for _, b in sums) >= 1 and gain > best[0] + 1e-7:
                    best = (gain, left)
        if level == depth or best[1] is None:
            if level:
                out[rows] += -rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        grow(rows[best[1]], level + 1, g, h, out)
        grow(rows[~best[1]], level + 1, g, h, out)

    margin = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(x)), 0, p - y, p * (1 - p), margin)
    return margin


def test_trees_equal_a_plain_recursion(spark):
    x, y = drawn(1, 150, 3)
    df = table(spark, x, y)
    cuts = boosting.quantile_cuts(df.select("x"))
    got = scores_of(boosting.boosted_trees(df.select("x", "y"), df.drop("y"), depth=3, rounds=5, rate=0.3))
    assert np.allclose(got, 1 / (1 + np.exp(-plain(x, y, cuts, 3, 5, 0.3))), atol=1e-6)


def test_spark_passes_grow_the_same_trees(spark, monkeypatch):
    """With samples of rows and entries, across stored margins and another partitioning."""
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    x, y = drawn(2, 120, 4)
    df = table(spark, x, y)
    options = {"depth": 2, "rounds": 3, "rate": 0.3, "rows": 0.7, "columns": 0.5}
    one = scores_of(boosting.boosted_trees(df.select("x", "y"), df.drop("y"), **options))
    two = scores_of(boosting.boosted_trees(df.select("x", "y").repartition(3), df.drop("y"), **options, local_cells=0))
    assert one == two and len(set(one)) > 3


def test_a_share_of_the_rows_is_drawn():
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000)
    draws = [boosting.drawn(keys, r, 0.8, 17) for r in (0, 1)]
    assert all(abs(d.mean() - 0.8) < 0.02 for d in draws) and abs((draws[0] & draws[1]).mean() - 0.64) < 0.02


def test_rules_are_learned(spark):
    """An interaction of three entries where trees see them all; a sum where each tree sees four of five."""
    x, y = drawn(4, 3_000, 5)
    for label, share in ((y, 1.0), ((x[:, 0] + x[:, 1] - x[:, 2] > 0).astype(int), 0.8)):
        df = table(spark, x, label)
        got = scores_of(boosting.boosted_trees(df.where("vec_id < 2000").select("x", "y"), df.where("vec_id >= 2000").drop("y"), rounds=60, rows=share, columns=share))
        assert np.mean((np.array(got) > 0.5) == label[2_000:]) > 0.9


def test_odd_rows(spark):
    """Unusable vectors score null and are not learned from; nor are rows without a label; one class gives one score."""
    x, y = drawn(5, 80, 3)
    nan, inf = float("nan"), float("inf")
    rows = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, nan, 2.0], 0), (103, [inf, 0.0, 0.0], 0), (104, [1.0], 1), (105, [], 0)]
    df = table(spark, x, y)
    odd = spark.createDataFrame([*rows, (106, [0.0, 0.0, 0.0], None)], SCHEMA)
    clean = scores_of(boosting.boosted_trees(df.select("x", "y"), df.drop("y"), depth=2, rounds=3))
    got = scores_of(boosting.boosted_trees(df.unionByName(odd).select("x", "y"), df.unionByName(odd).drop("y"), depth=2, rounds=3))
    assert got[:80] == clean and got[80:86] == [None] * 6 and got[86] is not None
    assert scores_of(boosting.boosted_trees(df.limit(0).select("x", "y"), df.drop("y"))) == [None] * 80
    assert boosting.boosted_trees(df.select("x", "y"), df.limit(0).drop("y"), rounds=2).collect() == []
    same = scores_of(boosting.boosted_trees(df.where("y = 1").select("x", "y"), df.drop("y"), rounds=2))
    assert len(set(same)) == 1 and same[0] > 0.99
