"""Affine scans over slices against one fold, and EWMA paths against the loop."""

import math

import numpy as np
import pytest

from noveltybench.operators import panel


@pytest.mark.parametrize(("factor", "steps", "length"), [(0.995, 900, 8), (0.2, 300, 16), (1.0, 100, 4), (1e-5, 70, 64), (0.9, 5, 64)])
def test_slices_equal_one_fold(spark, factor, steps, length):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, steps))
    x[1, 10:] = 0
    df = spark.createDataFrame([(e, t, float(x[e, t])) for e in (0, 1) for t in range(steps)], "entity long, t int, x double").repartition(3)
    start = spark.createDataFrame([(0, 2.5)], "entity long, start double")
    got = {(r["entity"], r["t"]): (r["before"], r["after"]) for r in panel.affine_scan(df, factor, "x", steps, start, length).collect()}
    assert len(got) == 2 * steps
    for e in (0, 1):
        v = 2.5 if e == 0 else 0.0
        for t in range(steps):
            before, v = v, factor * v + x[e, t]
            assert math.isclose(got[e, t][0], before, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(got[e, t][1], v, rel_tol=1e-9, abs_tol=1e-12)


def test_path_equals_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 400)) + np.arange(400) / 200
    x[2, :50] = 7.0  # no spread in the reference
    df = spark.createDataFrame([(e, t, float(x[e, t])) for e in range(3) for t in range(400)], "entity long, t int, x double")
    got = {(r["entity"], r["t"]): r["path"] for r in panel.ewma_path(df, "x", 50, 400).collect()}
    assert len(got) == 3 * 350 and all(got[2, t] is None for t in range(50, 400))
    for e in (0, 1):
        m, sd, v = x[e, :50].mean(), x[e, :50].std(), 0.0
        for t in range(50, 400):
            v = 0.95 * v + 0.05 * (x[e, t] - m) / sd
            m = 0.995 * m + 0.005 * x[e, t]
            assert math.isclose(got[e, t], v / math.sqrt(0.05 / 1.95), rel_tol=1e-8, abs_tol=1e-10)
    last = {r["entity"]: r["last"] for r in panel.ewma_last(df, "x", 0.2, 400).collect()}
    v = 0.0
    for t in range(400):
        v = 0.8 * v + 0.2 * x[1, t]
    assert math.isclose(last[1], v)


def test_factors_out_of_range(spark):
    with pytest.raises(ValueError):
        panel.affine_scan(spark.createDataFrame([(1, 0, 1.0)], "entity long, t int, x double"), 1.5, "x", 1)
