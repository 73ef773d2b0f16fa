import math

import numpy as np
import pytest

from noveltybench.llm import whitening

SF = "/root/testdata/sf0.01"


def plain(vectors):
    """Eigenvalues and vectors of the exact covariance of the grid vectors, by numpy."""
    x = np.array([[math.floor(c * 1024) + 100_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(axis=0)
    steps = n * x - s
    centred = steps / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, (steps.astype(object) ** 2).sum(axis=1), centred, values[order], components[:, order]


def compare(rows, vectors):
    """``vectors`` by vec_id, one row each."""
    ids = sorted(vectors)
    n, deviations, centred, values, components = plain([vectors[i] for i in ids])
    k = min(8, len(values))
    whitened = centred @ components[:, :k] / np.sqrt(values[:k])
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    for c in range(1, k + 1):
        mine = np.array([got[i, c]["whitened"] for i in ids])
        sign = np.sign(mine @ whitened[:, c - 1])
        assert np.allclose(mine, sign * whitened[:, c - 1], atol=1e-8)
    for i, d in zip(ids, deviations, strict=True):
        for c in range(1, k + 1):
            r = got[i, c]
            assert r["n"] == n and r["deviation"] == int(d) and r["identity_error"] < 1e-9
            assert math.isclose(r["explained"], values[c - 1] / values.sum(), rel_tol=1e-9)


def test_query_equals_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    compare(whitening.digest(df.repartition(7)).collect(), {r["vec_id"]: r["embedding"] for r in df.collect()})


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = {i: [float(v) for v in rng.normal(size=3)] for i in range(40)}
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    rows = [(i, v, 1.0, "n") for i, v in [*good.items(), *odd]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, n string")
    compare(whitening.digest(df).collect(), good)
    assert whitening.digest(df.where("vec_id >= 1000")).collect() == []
    assert whitening.digest(df.where("vec_id >= 100 and vec_id < 105")).collect() == []
    twice = whitening.digest(df.union(df)).collect()  # repeated rows all count
    assert len(twice) == 2 * 40 * 3 and {r["n"] for r in twice} == {80}
    none = spark.createDataFrame([(None, v) for v in good.values()], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in whitening.digest(none).collect()] == [None] * 120


def test_without_variance_there_is_no_component(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.digest(df).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert [r["component"] for r in whitening.digest(line).collect()] == [1] * 9
    assert whitening.whiten(line, whitening.fit(line)).count() == 9


def test_general_interface_whitens(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(str(i), [float(v) for v in rng.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(500)], "name string, v array<double>")
    model = whitening.fit(df, "v", components=4, scale=1 << 20, offset=0)
    w = np.array([r["out"] for r in whitening.whiten(df, model, "name", "v", "out").collect()])
    assert np.allclose(w.T @ w / len(w), np.eye(4), atol=1e-9)


def test_a_deviation_that_no_long_holds_is_null():
    centre = whitening.Centre(10, [0, 0])
    x = np.array([[3, 4], [1 << 40, 0], [303_700_049, 5]], np.int64)
    assert centre.deviations(x).tolist() == [2500, None, sum((10 * v) ** 2 for v in (303_700_049, 5)) if sum((10 * v) ** 2 for v in (303_700_049, 5)) < 2**63 else None]


MATRICES = {
    "random": np.random.default_rng(1).normal(size=(30, 30)),
    "few rows": np.random.default_rng(2).normal(size=(3, 20)),
    "identity": np.eye(12),
    "graded": np.linalg.qr(np.random.default_rng(3).normal(size=(20, 20)))[0] @ np.diag(10.0 ** -np.arange(20)),
    "multiple": np.linalg.qr(np.random.default_rng(4).normal(size=(24, 24)))[0] @ np.diag(np.repeat([3.0, 2.0, 1.0], 8)) @ np.linalg.qr(np.random.default_rng(5).normal(size=(24, 24)))[0],
    "close": np.linalg.qr(np.random.default_rng(6).normal(size=(24, 24)))[0] @ np.diag(1 + 1e-9 * np.arange(24)) @ np.linalg.qr(np.random.default_rng(7).normal(size=(24, 24)))[0],
    "rank two": np.random.default_rng(8).normal(size=(20, 2)) @ np.random.default_rng(9).normal(size=(2, 20)),
    "nothing": np.zeros((4, 4)),
    "one": np.array([[-2.0]]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_principal_directions(name):
    r = MATRICES[name]
    values, vectors = whitening.principal(r, 8)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert len(values) == min(8, int((want > 1e-25 * max(want[0], 1e-300)).sum()))
    if len(values):
        assert np.allclose(values, want[: len(values)], rtol=1e-10, atol=1e-13 * want[0])
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
        assert np.abs(r.T @ (r @ vectors) - vectors * values).max() < 1e-12 * want[0]


def test_qd_values_are_accurate_to_their_own_size():
    """Exact values of tiny determinants: products of the squares are those of the diagonal."""
    rng = np.random.default_rng(11)
    for _ in range(100):
        n = int(rng.integers(2, 30))
        q, e = 10.0 ** rng.uniform(-12, 0, n), 10.0 ** rng.uniform(-12, 0, n - 1)
        values = whitening.qd_values(q.tolist(), e.tolist())
        assert math.isclose(sum(map(math.log, values)), float(np.log(q).sum()), abs_tol=1e-9)
        assert math.isclose(sum(values), float(q.sum() + e.sum()), rel_tol=1e-12)


def test_zero_entries():
    assert whitening.qd_values([0.0, 1.0, 0.0], [1.0, 0.0]) == sorted(whitening.qd_values([0.0, 1.0, 0.0], [1.0, 0.0]), reverse=True)
    a, b = np.array([0.0, 1.0, 0.0, 2.0]), np.array([1.0, 0.5, 0.0])
    want = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
    assert np.allclose(whitening.qd_values((a * a).tolist(), (b * b).tolist()), want)
