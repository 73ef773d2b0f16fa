"""Coordination statistics and detection summaries against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from noveltybench.operators import attacks, coordination


def plain(b, lag):
    """Pairs of rows of the 0/1 matrix that hit at most ``lag`` steps apart on the circle."""
    return sum(float(np.triu(b @ np.roll(b, d, axis=1).T, 1).sum()) for d in range(-lag, lag + 1))


def matrix(seed, n, steps, share=0.15):
    return (np.random.default_rng(seed).random((n, steps)) < share).astype(int)


def table(spark, b):
    return spark.createDataFrame([(v, t, int(b[v, t])) for v in range(b.shape[0]) for t in range(b.shape[1])], "entity long, t int, b int")


@pytest.mark.parametrize("lag", [0, 1, 3, 8])
def test_statistic_equals_all_pairs(spark, lag, monkeypatch):
    monkeypatch.setattr(coordination, "SLICE", 16)  # many slices, with hits at their edges
    b = matrix(1, 9, 70)
    b[2, [0, 1, 68, 69]] = 1  # next to each other round the end
    assert coordination.statistic(table(spark, b), lag).first()["stat"] == plain(b, lag)


def test_a_hot_time_and_no_hits(spark):
    b = matrix(2, 40, 12, 0.0)
    b[:, 5] = 1
    assert coordination.statistic(table(spark, b), 2).first()["stat"] == 40 * 39 / 2
    none = coordination.shift_test(table(spark, b * 0), 20, 1, lag=1).first()
    assert (none["stat"], none["p"]) == (0, 1.0)
    with pytest.raises(PySparkException):
        coordination.statistic(table(spark, b), 12).collect()


def test_bins(spark):
    b = matrix(3, 6, 22)
    got = {(r["entity"], r["t"]): r["b"] for r in coordination.binned(table(spark, b), 4).collect()}
    assert got == {(v, t): int(b[v, 4 * t : 4 * t + 4].max()) for v in range(6) for t in range(6)}


@pytest.mark.parametrize(("lag", "period"), [(0, None), (2, None), (0, 7), (3, 7)])
def test_shift_tests_equal_rolled_matrices(spark, lag, period, monkeypatch):
    monkeypatch.setattr(coordination, "CELLS", 64)  # several messages a task
    b = matrix(4, 8, 50)
    b[:4, [3, 17, 31]] = 1
    count = 50 // period if period else 50
    null = [plain(np.stack([np.roll(b[v], coordination.shift(9, p, v, count) * (period or 1)) for v in range(8)]), lag) for p in range(30)]
    got = coordination.shift_test(table(spark, b).repartition(3), 30, 9, lag, period).first()
    assert got["stat"] == plain(b, lag) and math.isclose(got["p"], (1 + sum(s >= got["stat"] for s in null)) / 31)


@pytest.mark.parametrize("lag", [0, 2])
def test_historical_null(spark, lag):
    b = matrix(5, 7, 63, 0.2)  # six whole periods of ten, three steps left over
    b[:5, 52] = 1
    stats = [plain(b[:, 10 * i : 10 * i + 10], lag) for i in range(6)]
    got = coordination.historical_test(table(spark, b), 10, lag).first()
    assert got["stat"] == stats[-1] and math.isclose(got["p"], (1 + sum(s >= stats[-1] for s in stats[:-1])) / 6)


def test_attacks_equal_loops(spark):
    """Overlapping, long, empty and unseen attacks, on an entity with many steps."""
    rnd = random.Random(6)
    steps = [(v, t, rnd.random(), math.exp(rnd.gauss(0, 1)), rnd.random() < 0.05) for v in range(4) for t in range(0, 900, 3)]
    cases = [(rnd.choice("ab"), rnd.randrange(5), rnd.randrange(-20, 900), rnd.choice([0, 1, 5, 63, 64, 65, 300])) for _ in range(120)] + [("c", 99, 0, 10), ("a", 1, 30, 100), ("a", 1, 60, 100)]
    attack = spark.createDataFrame(cases, "setting string, entity long, t0 int, duration int")
    found = attacks.each_attack(spark.createDataFrame(steps, "entity long, t int, p double, e double, alarm boolean"), attack, stride=3)
    want = {}
    for s, v, t0, d in set(cases):
        inside = [x for x in steps if x[0] == v and t0 <= x[1] < t0 + d]
        hits = [x[1] for x in inside if x[4]]
        want[s, v, t0, d] = (len(inside), (min(hits) - t0) / 3 if hits else None, sum(math.log(x[3]) for x in inside), sum(x[2] <= 0.01 for x in inside) / len(inside) if inside else None)
    got = {(r["setting"], r["entity"], r["t0"], r["duration"]): (r["evaluated"], r["delay"], r["log_e"], r["share"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all(a == b if a is None or b is None else math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[k], w, strict=True)), k
    summary = {r["setting"]: r for r in attacks.detection_summary(found, 20.0).collect()}
    for s in "abc":
        mine = [w for k, w in want.items() if k[0] == s]
        delays = [w[1] for w in mine if w[1] is not None]
        r, n = summary[s], sum(w[0] for w in mine)
        assert (r["attacks"], r["windows"]) == (len(mine), n) and math.isclose(r["detected"], len(delays) / len(mine))
        assert r["median_delay"] == (None if not delays else pytest.approx(float(np.median(delays))))
        mean = sum(w[2] for w in mine) / n if n else None
        assert r["mean_log_e"] == (None if mean is None else pytest.approx(mean))
        assert r["predicted_delay"] == (pytest.approx(math.log(20) / mean) if mean and mean > 0 else None)


def test_no_step_table_is_formed_for_distant_times(spark):
    """The join is on entity and bucket, not on entity alone."""
    steps = spark.createDataFrame([(1, t, 0.5, 1.0, False) for t in range(10)], "entity long, t int, p double, e double, alarm boolean")
    plan = attacks.steps_within(steps, spark.createDataFrame([("a", 1, 0, 5)], "setting string, entity long, t0 int, duration int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan and F is not None
