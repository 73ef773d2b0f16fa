import datetime

import numpy as np
import pytest

from noveltybench.operators import detectors
from noveltybench.plans import registry


def stages(spark):
    """Spark's records of the stages so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [listed.apply(i) for i in range(listed.size())]


def rows_shuffled(spark, run):
    last = max([s.stageId() for s in stages(spark)], default=-1)
    run()
    return sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() > last)


def test_the_reference_is_shuffled_once_whatever_the_parts(spark, monkeypatch):
    """Each part once got a copy of the reference through the shuffle."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3_000, 4)))], "vec_id long, x array<double>")
    seen = []
    for size in (4_000, 40):
        monkeypatch.setattr(detectors, "PROBE_ROWS", size)
        seen.append(rows_shuffled(spark, lambda: detectors.knn(df.where("vec_id < 400"), df, "vec_id").collect()))
    assert seen[0] == seen[1] < 4_000


@pytest.mark.parametrize("name", ["score_grid_sets", "score_grid"])
def test_a_grid_shuffles_the_same_rows_whatever_the_parts(spark, sf, monkeypatch, name):
    seen = []
    for size in (4_000, 40):
        monkeypatch.setattr(detectors, "PROBE_ROWS", size)
        seen.append(rows_shuffled(spark, lambda: registry.queries()[name](spark, sf).collect()))
    assert seen[0] == seen[1]


def bytes_moved(spark, run):
    """What a run writes for shuffles, spills and tables."""
    last = max([s.stageId() for s in stages(spark)], default=-1)
    run()
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in stages(spark) if s.stageId() > last)


@pytest.mark.parametrize("name", ["score_grid_sets", "score_grid"])
def test_a_row_more_moves_a_few_vectors_more(spark, tmp_path, monkeypatch, name):
    """Pairs of blocks, and then parts, each once got vectors of their own, so what was moved grew with probes times reference."""
    monkeypatch.setattr(detectors, "PROBE_ROWS", 50)
    monkeypatch.setattr(detectors, "BLOCK_ROWS", 50)
    rng, seen = np.random.default_rng(9), []
    for size in (1_000, 3_000):
        rows = [(i, v.tolist(), i % 10) for i, v in enumerate(rng.normal(size=(size, 64)))]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{size}/embeddings.parquet")
        seen.append(bytes_moved(spark, lambda at=f"{tmp_path}/{size}": registry.queries()[name](spark, at).collect()))
    assert (seen[1] - seen[0]) / 2_000 < 4 * 64 * 8


def test_wide_vectors_other_columns_and_odd_probes(spark, monkeypatch):
    """Parts and blocks hold fewer of wider vectors; what else a probe has stays with it, and odd ones get null."""
    monkeypatch.setattr(detectors, "PART_ROWS", 64)
    monkeypatch.setattr(detectors, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(8)
    x, day = rng.normal(size=(100, 200)), datetime.datetime(2024, 1, 2)
    rows = [(i, f"s{i % 3}", day if i % 4 else None, {"a": i}, v.tolist()) for i, v in enumerate(x)]
    odd = [(100, "n", day, None, None), (101, None, None, None, [1.0]), (102, "f", day, {}, [float("nan")] * 200), (103, "z", day, {}, [0.0] * 200)]
    df = spark.createDataFrame(rows + odd, "vec_id long, set_name string, at timestamp, more map<string,long>, x array<double>")
    got = {r["vec_id"]: r for r in detectors.knn(df, df.where("vec_id < 100"), "vec_id").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sqrt(np.sort(np.maximum(2 - 2 * u @ u.T, 0), axis=1)[:, 9])
    assert len(got) == 104
    np.testing.assert_allclose([got[i]["score"] for i in range(100)], want, atol=1e-7)
    assert [got[i]["score"] for i in (100, 101, 102)] == [None] * 3 and abs(got[103]["score"] - 2**0.5) < 1e-12
    assert [(got[r[0]]["set_name"], got[r[0]]["at"], got[r[0]]["more"]) for r in rows + odd] == [(r[1], r[2], r[3]) for r in rows + odd]
