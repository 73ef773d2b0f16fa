"""Null vectors and empty references in every detector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltybench.operators import detectors

FITTED = {
    "mahalanobis": detectors.mahalanobis,
    "whitened": detectors.whitened_norm,
    "pca": detectors.pca_reconstruction,
    "knn": lambda v, r: detectors.knn(v, r, "vec_id"),
    "forest": lambda v, r: detectors.isolation_forest(v, r, "vec_id", trees=5, rows=16),
}


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0])]
    return spark.createDataFrame(good, "vec_id long, x array<double>"), spark.createDataFrame(odd, "vec_id long, x array<double>")


@pytest.mark.parametrize("name", FITTED)
def test_unusable_vectors_have_null_scores(tables, name):
    good, odd = tables
    both = good.unionByName(odd)
    plain = {r["vec_id"]: r["score"] for r in FITTED[name](good, good).collect()}
    got = {r["vec_id"]: r["score"] for r in FITTED[name](both, both).collect()}
    assert len(got) == 65 and all(got[i] is None for i in range(100, 105))
    if name != "forest":  # its trees are drawn by keys, among which the odd rows are
        np.testing.assert_allclose([got[i] for i in range(60)], [plain[i] for i in range(60)], atol=1e-9)
    assert all(got[i] is not None for i in range(60))


@pytest.mark.parametrize("name", FITTED)
def test_without_a_reference_scores_are_null(tables, name):
    good, odd = tables
    for empty in (good.where("false"), odd):
        got = FITTED[name](good, empty).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("known")).first()
        assert (got["n"], got["known"]) == (60, 0)
