import numpy as np

from noveltybench.operators import detectors


def probe_rows_emitted(spark, reference_rows):
    """Rows that the search hands on to the shuffle behind it, for 300 probes."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(reference_rows, 4)))], "vec_id long, x array<double>")
    found = detectors.knn(df.where("vec_id < 300"), df, "vec_id")
    assert found.where("score is not null").count() == 300
    found.collect()
    return sum(node.metrics().apply("pythonNumRowsReceived").value() for node in searches(found._jdf.queryExecution().executedPlan()))


def searches(plan):
    """The nodes of a run plan that search in Python."""
    names, todo = [], [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "MapInArrowExec":
            names.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return names


def test_a_probe_is_one_row_however_large_the_reference(spark):
    """Each block of the reference once sent ten rows a probe, so what was shuffled grew with their product."""
    assert probe_rows_emitted(spark, 3_000) == probe_rows_emitted(spark, 9_000) == 300


def test_parts_blocks_and_copies(spark, monkeypatch):
    """Several parts a task, batches that end inside a part, vectors that repeat, and fewer rows than neighbours."""
    monkeypatch.setattr(detectors, "PROBE_ROWS", 40)
    monkeypatch.setattr(detectors, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 5))
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(2 - 2 * u @ u.T, 0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for size in (500, 4):
            got = {r["vec_id"]: r["score"] for r in detectors.knn(df, df.where(f"vec_id < {size}"), "vec_id").collect()}
            want = np.sort(d[:, :size], axis=1)[:, min(10, size) - 1]
            np.testing.assert_allclose([got[i] for i in range(500)], want, atol=1e-7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
