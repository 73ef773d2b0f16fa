import numpy as np

from noveltybench.operators import detectors


def test_knn_searches_the_whole_reference(spark):
    """More rows than any sample held before, in several blocks, with a vector that repeats."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6_000, 6))
    x[:15] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    got = {r["vec_id"]: r["score"] for r in detectors.knn(df.where("vec_id < 400"), df, "vec_id").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sqrt(np.sort(np.maximum(2 - 2 * u[:400] @ u.T, 0), axis=1)[:, 9])
    assert len(got) == 400
    np.testing.assert_allclose([got[i] for i in range(400)], want, atol=1e-7)
