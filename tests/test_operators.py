"""Brute-force, property and negative tests of operators."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from noveltybench.operators import audit, clean, detectors, metrics, panel, ranks, scores, splits, verify, windows
from noveltybench.sources import tables


def flows(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, float(rnd.randint(0, 4_000)), rnd.choice(["Benign", "Benign", "dos", "scan"]), rnd.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, t_ms double, cls string, f1 double")


def test_windows_equal_brute_force(spark):
    rows, df = flows(spark)
    coded = windows.numbered(windows.class_codes(windows.time_blocks(df, 500.0)))
    got = {(r["grp"], r["k"]): r for r in windows.window_labels(windows.count_windows(coded, 6, 4), 6).collect()}
    code = {"Benign": 0, "dos": 1, "scan": 2}
    first = min(r[1] for r in rows)
    blocks = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        blocks.setdefault(math.floor((r[1] - first) / 500.0), []).append(code[r[2]])
    want = {}
    for grp, b in enumerate(sorted(blocks)):
        c = blocks[b]
        for k in range((len(c) - 6) // 4 + 1 if len(c) >= 6 else 0):
            w = c[k * 4 : k * 4 + 6]
            attack = [x for x in w if x]
            top = max((attack.count(x) for x in attack), default=0)
            cls = min((x for x in attack if attack.count(x) == top), default=0)
            want[grp, k] = (k * 4, int(bool(attack)), cls, w.count(cls) / 6, [sum({1 << x for x in w})], len(attack))
    assert {k: (r["start_rn"], r["y_bin"], r["y_cls"], r["purity"], r["class_mask"], r["n_attack"]) for k, r in got.items()} == want


def test_missing_time_and_class_are_errors(spark):
    df = spark.createDataFrame([(1, float("nan"), "Benign")], "row_id long, t_ms double, cls string")
    with pytest.raises(PySparkException):
        windows.time_blocks(df, 10.0).collect()
    with pytest.raises(PySparkException):
        windows.class_table(spark.createDataFrame([(None,)], "cls string")).collect()


def test_family_map_must_cover(spark):
    classes = spark.createDataFrame([("Benign",), ("dos",), ("new",)], "cls string")
    with pytest.raises(PySparkException):
        windows.family_table(classes, {"Benign": ["Benign"], "A": ["dos"]}).collect()
    with pytest.raises(ValueError):
        windows.family_table(classes, {"A": ["dos"]})


def test_balance_is_exact(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(1000)]
    got = splits.balance_exact_ratio(spark.createDataFrame(rows, "window_id long, y_bin int"), 5, 300, 3).collect()
    assert sum(r["y_bin"] for r in got) == 50 and len(got) == 300 and len({r["window_id"] for r in got}) == 300


def test_validators_fail_on_a_leak(spark):
    leaky = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "sha string, split string")
    with pytest.raises(verify.CheckFailed, match="hash_disjoint: 1"):
        verify.enforce(verify.disjoint(leaky, "sha", "split", "hash_disjoint"))
    verify.enforce(verify.unique(leaky.where("split <> 'test'"), "sha", "hash_unique"))
    bad = spark.createDataFrame([(1, 0, "train", False), (2, 0, "test", False)], "block long, day int, split string, purged boolean")
    assert {r["check_name"]: r["violations"] for r in verify.purge(bad).collect()} == {"kept_beside_test": 1, "train_beside_val": 0}


def test_cleaner_sees_training_rows_only(spark):
    rows = [(float(i), float("nan") if i == 3 else float(i * 2)) for i in range(10)]
    train = spark.createDataFrame(rows, "a double, b double")
    params = [r.asDict() for r in clean.fit(train, ["a", "b"], ["b"]).collect()]
    other = clean.transform(spark.createDataFrame([(1e9, -5.0)], "a double, b double"), params).first()
    b = np.log1p([x if not np.isnan(x) else np.median([y for _, y in rows if not np.isnan(y)]) for _, x in rows])
    assert np.isclose(other["b"], (0 - b.mean()) / b.std()) and other["a"] > 1e8
    assert clean.correlation_prune([("a", "b", 1.0), ("a", "c", -0.9999999), ("b", "c", 1.0)], ["a", "b", "c"]) == {"b": "a", "c": "a"}


def test_audit_finds_unsorted_chunks(spark):
    up = spark.createDataFrame([(i, float(i)) for i in range(50)], "i long, t double")
    assert audit.sorted_by_id(up, "t", "i", 7).first()["is_sorted"]
    assert not audit.sorted_by_id(up.withColumn("t", F.when(F.col("i") == 14, 2.0).otherwise(F.col("t"))), "t", "i", 7).first()["is_sorted"]


def test_running_sums_over_buckets(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=700).round(2)]
    levels = spark.createDataFrame([(v, 1.0) for v in values], "v double, n double").groupBy("v").agg(F.sum("n").alias("n"))
    want = {v: float(sum(x < v for x in values)) for v in set(values)}
    for buckets in (1, 8, None):
        assert {r["v"]: r["n_before"] for r in ranks.running(levels, [], "v", ["n"], buckets).collect()} == want


def test_buckets_follow_the_largest_group(spark, monkeypatch):
    """Answers stay the same when a task may sort few values; the number of buckets comes from counts."""
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=200).round(2)] + [("b", float(v)) for v in rng.normal(size=5).round(2)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: float(np.quantile([v for g, v in rows if g == k], 0.3)) for k in "ab"}
    flow = spark.createDataFrame([(i, float(rng.integers(0, 900)), i % 2) for i in range(400)], "row_id long, t_ms double, grp int")
    places = {r["row_id"]: r["rn"] for r in windows.numbered(flow, slice_ms=50.0).collect()}
    for most in (100_000, 9):
        monkeypatch.setattr(ranks, "PER_BUCKET", most)
        got = {r["k"]: r["q"] for r in ranks.quantile(df, ["k"], "v", 0.3, "q").collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
        assert {r["row_id"]: r["rn"] for r in windows.numbered(flow, slice_ms=50.0).collect()} == places
    levels = df.groupBy("k", "v").count()
    n = levels.where("k = 'a'").count()
    assert ranks.fitting(levels, ["k"]) == -(-n // 9) and ranks.fitting(levels.where("false"), ["k"]) == 1


def test_auc_and_delong(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    a, b = (y + rng.normal(size=200)).round(1), rng.normal(size=200).round(1)
    df = spark.createDataFrame([(int(i), float(p), float(q)) for i, p, q in zip(y, a, b, strict=True)], "y int, a double, b double")
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in a[y == 1] for n in a[y == 0]])
    assert np.isclose(metrics.auc(df.select("y", F.col("a").alias("score")), []).first()["auc"], brute)
    d = metrics.delong(df, "a", "b").first()
    assert np.isclose(d["auc_a"], brute) and d["p"] < 0.01


def test_holm(spark):
    got = {r["k"]: round(r["adjusted"], 9) for r in metrics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", "k").collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_parseval_and_recurrence(spark):
    x = [float(v) for v in np.random.default_rng(3).normal(size=32)]
    df = spark.createDataFrame([(x,)], "x array<double>")
    r = df.select(scores.power(F.col("x"), 32).alias("p"), scores.linear_recurrence(F.col("x"), 0.3, 0.2, 0.1).alias("y")).first()
    assert np.isclose(sum(r["p"]), np.mean(np.square(x)))
    h = e = 0.0
    for u, y in zip(x, r["y"], strict=True):
        h = h + 0.3 * (u - h) + 0.2 * (e - h)
        e = e + 0.1 * (h - e)
        assert np.isclose(y, h - e)


def test_ecusum_forms(spark):
    rng = np.random.default_rng(4)
    es = [float(v) for v in np.exp(rng.normal(scale=0.7, size=80))]
    df = spark.createDataFrame([(1, t, e) for t, e in enumerate(es)], "entity long, t int, e double")
    m, alarms, free, first = 1.0, [], 1.0, None
    for t, e in enumerate(es):
        m, free = max(m, 1.0) * e, max(free, 1.0) * e
        if m >= 3:
            alarms.append(t)
            m = 1.0
        if free >= 3 and first is None:
            first = t
    assert panel.ecusum_reset(df, 3.0).first()["alarms"] == alarms
    assert panel.ecusum_no_reset(df, 3.0).first()["first_alarm"] == first


def scores_of(df):
    return [r["score"] for r in df.orderBy("vec_id").collect()]


def reconstructed(x, explained):
    c = x - x.mean(axis=0)
    _, sizes, basis = np.linalg.svd(c, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(sizes**2) / (sizes**2).sum(), explained)) + 1
    return ((c - c @ basis[:k].T @ basis[:k]) ** 2).mean(axis=1)


def test_forest_samples_are_whole_and_bounded(spark):
    """A reference below the bound is used whole by every tree; a larger one by as many rows as asked."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    far = spark.createDataFrame([(-1, [9.0, 9.0, 9.0])], "vec_id long, x array<double>")
    for part in (df.where("vec_id < 40"), df):
        got = {r["vec_id"]: r["score"] for r in detectors.isolation_forest(far.unionByName(part), part, "vec_id", trees=30, rows=64).collect()}
        assert got[-1] == max(got.values()) and got[-1] > 0.6 and np.median(list(got.values())) < 0.55


def test_detectors_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, x array<double>")
    mean = x.mean(axis=0)
    s = (x - mean).T @ (x - mean) / len(x)
    mu = np.trace(s) / 5
    delta = ((s - mu * np.eye(5)) ** 2).sum()
    beta = (np.mean(((x - mean) ** 2).sum(axis=1) ** 2) - (s**2).sum()) / len(x)
    shrink = min(beta, delta) / delta
    p = np.linalg.inv((1 - shrink) * s + shrink * mu * np.eye(5))
    got = {r["vec_id"]: r["score"] for r in detectors.mahalanobis(df, df).collect()}
    assert np.allclose([got[i] for i in range(300)], np.sqrt(np.einsum("ni,ij,nj->n", x - mean, p, x - mean)))
    assert np.allclose(scores_of(detectors.pca_reconstruction(df, df, 0.9)), reconstructed(x, 0.9))
    shrunk = 0.9 * s + 0.1 * mu * np.eye(5)
    values, basis = np.linalg.eigh(shrunk)
    white = basis @ np.diag(values**-0.5) @ basis.T
    assert np.allclose(scores_of(detectors.whitened_norm(df, df)), np.linalg.norm((x - mean) @ white, axis=1))
    far = spark.createDataFrame([(1000, [50.0] * 5)], "vec_id long, x array<double>").unionByName(df)
    forest = {r["vec_id"]: r["score"] for r in detectors.isolation_forest(far, df, "vec_id", trees=20, rows=64).collect()}
    assert forest[1000] == max(forest.values())


def test_archive_is_closed(spark, tmp_path):
    w = spark.createDataFrame([(1, 0), (2, 1)], "window_id long, y_bin int")
    m = spark.createDataFrame([("train", 1), ("test", 3)], "set_name string, window_id long")
    tables.write_archive(str(tmp_path / "a"), w, w, m, w)
    assert tables.archive_windows(spark, str(tmp_path / "a"), "train").count() == 1
    with pytest.raises(PySparkException):
        tables.archive_windows(spark, str(tmp_path / "a"), "test").collect()


def test_changed_files_are_found(spark, tmp_path):
    def write(name, values):
        spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
        return next(p.name for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))

    same, gone = write("a", [1, 2]), write("b", [3])
    old = spark.createDataFrame(tables.content_manifest(spark, str(tmp_path)).collect())
    assert {(r["name"], r["rows"], r["columns"]) for r in old.collect()} == {(same, 2, "v"), (gone, 1, "v")}
    new = write("b", [4])
    found = {r["name"]: r["change"] for r in tables.manifest_changes(old, tables.content_manifest(spark, str(tmp_path))).collect()}
    assert found == {gone: "gone", new: "new"}
    edited = old.withColumn("digest", old["name"])
    assert {r["change"] for r in tables.manifest_changes(edited, old).collect()} == {"digest"}
