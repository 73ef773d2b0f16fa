"""Class bitsets of any width, and the folds and sets decided by them, against plain sets."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from noveltybench.functions import bitset
from noveltybench.operators import splits, verify, windows


def as_set(words):
    return {64 * i + b for i, w in enumerate(words or []) for b in range(64) if (w >> b) & 1}


def test_bitsets_equal_sets(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.randrange(200) for _ in range(rnd.randint(0, 6))], [rnd.randrange(130) for _ in range(rnd.randint(0, 6))]) for i in range(300)] + [(300, [63, 64, 0], [127, 128])]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>").withColumn("x", bitset.from_bits(F.col("a"))).withColumn("y", bitset.from_bits(F.col("b")))
    got = df.select("a", "b", "x", bitset.union(F.col("x"), F.col("y")).alias("u"), bitset.overlaps(F.col("x"), F.col("y")).alias("o"), bitset.count(F.col("x")).alias("n"),
                    F.transform(F.sequence(F.lit(0), F.lit(199)), lambda c: bitset.has(F.col("x"), c)).alias("h")).collect()
    for r in got:
        a, b = set(r["a"]), set(r["b"])
        assert as_set(r["x"]) == a and as_set(r["u"]) == a | b and r["o"] == bool(a & b) and r["n"] == len(a)
        assert [i for i, h in enumerate(r["h"]) if h] == sorted(a)
    for bad in ([1, None], [-1]):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "a array<int>").select(bitset.from_bits(F.col("a"))).collect()
    assert as_set(spark.createDataFrame([(1, 5), (1, 190), (1, None)], "k int, c int").groupBy("k").agg(bitset.gathered(F.col("c")).alias("s")).first()["s"]) == {5, 190}


@pytest.fixture(scope="module")
def many_classes(spark):
    """Windows of three flows over 130 classes; a window's classes are told by its flows alone."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["Benign"] * 40 + [f"a{c:03d}" for c in range(130)])) for i in range(6000)]
    rows += [(i, "a129" if i % 3 == 0 else "Benign") for i in range(6000, 6600)]
    flows = spark.createDataFrame([(i, float(i), c) for i, c in rows], "row_id long, t_ms double, cls string")
    coded = windows.numbered(windows.class_codes(windows.time_blocks(flows, 60.0)))
    w = windows.window_labels(windows.count_windows(coded, 3, 3), 3).withColumn("window_id", F.col("grp") * 1000 + F.col("k"))
    placed = w.withColumn("split", F.when(F.col("grp") < 60, "train").when(F.col("grp") < 80, "val").otherwise("test"))
    code = {r["cls"]: r["code"] for r in windows.class_table(flows).collect()}
    of = {}
    for i, c in rows:
        of.setdefault((i // 60) * 1000 + (i % 60) // 3, set()).add(code[c])
    return placed.cache(), of, windows.class_table(flows)


def test_windows_of_130_classes(many_classes):
    placed, of, classes = many_classes
    got = {r["window_id"]: as_set(r["class_mask"]) for r in placed.collect()}
    assert got == of and max(max(s) for s in of.values()) == 130


def test_folds_of_130_classes(many_classes):
    placed, of, classes = many_classes
    rows = splits.loaco_folds(placed, classes, 7, min_train=15).collect()
    train = {r["window_id"] for r in placed.where("split = 'train'").collect()}
    enough = {c for c in range(1, 131) if sum(c in of[w] for w in train) >= 15}
    assert {r["fold"] for r in rows} == enough and any(f > 64 for f in enough)
    assert all(r["fold"] not in of[r["window_id"]] for r in rows if r["part"] != "test")
    assert all(r["fold"] in of[r["window_id"]] or r["y_bin"] == 0 for r in rows if r["part"] == "test")
    folds = splits.loaco_folds(placed, classes, 7, min_train=15)
    assert all(r["ok"] for r in verify.loaco(folds, placed).collect())


def test_novel_classes_beyond_the_first_word(many_classes):
    placed, of, classes = many_classes
    without = placed.where((F.col("split") != "train") | ~bitset.has(F.col("class_mask"), F.lit(130)))
    novel = splits.nn_class_discovery(without, classes, least=20)
    assert {r["code"]: r["status"] for r in novel.collect()}[130] == "novel"
    sets = splits.natural_novelty_sets(placed, novel.where("status = 'novel'"), 7).collect()
    assert sets and all(130 not in of[r["window_id"]] for r in sets if r["part"] != "test")
    assert {r["cls"] for r in sets if r["part"] == "test"} >= {130}
    cut = splits.rolling_feasibility(without.drop("split"), placed.groupBy("grp").agg(F.first("split").alias("split")).select(F.lit(0.6).alias("cut"), "grp", F.lit(1).alias("n"), "split"), classes).first()
    assert cut["novel"] >= 1
