"""Novelty packages against plain loops, and a broken package for each check."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from noveltybench.functions import bitset
from noveltybench.operators import packages, verify


@pytest.fixture(scope="module")
def world(spark):
    """20 groups of 40 windows: 12 train, one gap, 2 val, 5 test; class 70 occurs in test only, and in one early window."""
    rnd = random.Random(8)
    rows = []
    for g in range(20):
        split = "train" if g < 12 else "gap" if g == 12 else "val" if g < 15 else "test"
        for k in range(40):
            classes = {rnd.choice([0, 0, 1, 2])} | ({70} if split == "test" and k % 5 == 0 else set()) | ({70, 1} if (g, k) == (3, 7) else set())
            y = 70 if 70 in classes and split == "test" else max(c for c in classes if c != 70)
            rows.append((g * 100 + k, g, k, int(y > 0), y, sorted(classes), split))
    df = spark.createDataFrame(rows, "window_id long, grp int, k long, y_bin int, y_cls int, classes array<int>, split string")
    placed = df.withColumn("class_mask", bitset.from_bits(F.col("classes"))).drop("classes").cache()
    novel = spark.createDataFrame([(70, "late")], "code int, cls string")
    return rows, placed, novel


def draw(ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:5".encode()).hexdigest(), i))


def test_package_equals_loops(world):
    rows, placed, novel = world
    got = {}
    for r in packages.novelty_package(placed, novel, 5, (10, 35), test_benign=30, test_class=12).collect():
        got.setdefault(r["set_name"], set()).add(r["window_id"])
    head = {g for g in range(12) if g * 40 < 0.8 * 480}

    def balanced(groups, ratio, cap):
        mine = [r for r in rows if r[1] in groups and r[6] == "train" and 70 not in r[5]]
        attack, benign = [r[0] for r in mine if r[3]], [r[0] for r in mine if not r[3]]
        n = min(len(attack), cap // (1 + ratio), len(benign) // ratio)
        return set(draw(attack)[:n] + draw(benign)[: n * ratio])

    benign = sorted((r[1], r[2], r[0]) for r in rows if r[6] == "test" and not r[3])
    closed = {g for g, _, _ in benign[:35]}
    pool = [r for r in rows if r[6] == "test" and r[1] not in closed]
    want = {
        "train": balanced(head, 1, 14_000),
        "val": balanced(set(range(12)) - head, 5, 3_000),
        "anchor_10": {i for *_, i in benign[:10]},
        "anchor_35": {i for *_, i in benign[:35]},
        "test_benign": set(draw([r[0] for r in pool if not r[3]])[:30]),
        "test/late": set(draw([r[0] for r in pool if r[4] == 70])[:12]),
    }
    assert got == want and all(want.values())
    whole = packages.novelty_package(placed, novel, 5, ())
    assert {r["set_name"] for r in whole.select("set_name").distinct().collect()} == {"train", "val", "test_benign", "test/late"}
    verify.enforce(packages.verify_package(whole, placed, novel))


BROKEN = {
    "learned_in_train": ("train", "split = 'val'"),
    "head_and_tail_apart": ("val", "grp = 2 and y_bin = 0"),
    "tail_after_head": ("val", "grp = 2 and y_bin = 0"),
    "no_novel_flow_learned": ("train", "window_id = 307"),
    "tested_in_test": ("test_benign", "split = 'val' and y_bin = 0"),
    "test_without_anchor_groups": ("test_benign", "grp = 15 and y_bin = 0"),
    "anchors_benign": ("anchor_35", "split = 'test' and y_bin = 1"),
    "anchors_nested": ("anchor_10", "split = 'gap' and y_bin = 0"),
    "test_benign_is_benign": ("test_benign", "grp = 19 and y_bin = 1"),
    "class_sets_hold_their_class": ("test/late", "grp = 19 and y_cls = 1"),
    "novel_class_not_learned": ("train", "split = 'test' and y_cls = 70"),
}


@pytest.fixture(scope="module")
def sound(world):
    _, placed, novel = world
    return packages.novelty_package(placed, novel, 5, (10, 35)).cache()


def violations(members, world):
    return {r["check_name"]: r["violations"] for r in packages.verify_package(members, world[1], world[2]).collect()}


def test_a_sound_package_passes(sound, world):
    found = violations(sound, world)
    assert set(found.values()) == {0} and len(found) == 14 and set(BROKEN) < set(found)


def test_each_check_fails_on_a_broken_package(sound, world):
    """One package with every fault."""
    broken = sound
    for where, rows in BROKEN.values():
        broken = broken.unionByName(world[1].where(rows).select(F.lit(where).alias("set_name"), "window_id", "grp", "y_bin"))
    found = violations(broken.where("set_name <> 'val' or y_bin = 0"), world)
    assert all(found[name] > 0 for name in BROKEN) and found["val_has_both_labels"] == 1


def test_missing_and_repeated_rows_fail(sound, world):
    found = violations(sound.where("set_name <> 'test/late'").unionByName(sound.where("set_name = 'val'")), world)
    assert found["class_sets_not_empty"] == 1 and found["no_window_twice"] == sound.where("set_name = 'val'").count()
