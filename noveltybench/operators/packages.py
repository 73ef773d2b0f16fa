"""Novelty packages: train on the head of the train period, validate on its tail, re-anchor and test on the test period.

Placed windows have window_id, grp, k, y_bin, y_cls, class_mask and split; novel classes are (code, cls).  Groups decide
all borders; only tables of groups, of classes and of the first anchors are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.functions import bitset
from noveltybench.functions.sampling import md5_order
from noveltybench.operators.splits import TEST, TRAIN, balance_exact_ratio, head_tail_train
from noveltybench.operators.verify import check, together

#: Nested anchor sets, benign test windows, and windows of each novel class.
ANCHORS, TEST_BENIGN, TEST_CLASS = (100, 500), 2_500, 500


def _mask(novel: DataFrame) -> DataFrame:
    return novel.agg(bitset.gathered(F.col("code")).alias("__novel"))  # one row


def _touched() -> Column:
    return bitset.overlaps(F.col("class_mask"), F.col("__novel"))


def novelty_package(
    placed: DataFrame, novel: DataFrame, seed: int, anchors: tuple[int, ...] = ANCHORS, head_share: float = 0.8, train_cap: int = 14_000, val_ratio: int = 5, val_cap: int = 3_000, test_benign: int = TEST_BENIGN, test_class: int = TEST_CLASS
) -> DataFrame:
    """(set_name, window_id, grp, y_bin) of the sets train, val, anchor_<n>, test_benign and test/<class>.

    Train is balanced 1:1 from the head groups and val from the tail groups, neither with a flow of a novel class.  An
    anchor set is the first n benign test windows in time; test windows come from groups without any anchor.  Without
    anchors the test pool is the whole test period.
    """

    def named(rows: DataFrame, name: Column | str) -> DataFrame:
        return rows.select((F.lit(name) if isinstance(name, str) else name).alias("set_name"), "window_id", "grp", "y_bin")

    sides = head_tail_train(placed, head_share).select("grp", "side")
    learned = placed.where(F.col("split") == TRAIN).join(sides, "grp").crossJoin(F.broadcast(_mask(novel))).where(~_touched())
    parts = [named(balance_exact_ratio(learned.where("side = 'head'"), 1, train_cap, seed), "train"), named(balance_exact_ratio(learned.where("side = 'tail'"), val_ratio, val_cap, seed), "val")]
    tested = placed.where(F.col("split") == TEST)
    pool = tested
    if anchors:
        first = tested.where("y_bin = 0").orderBy("grp", "k").limit(max(anchors))
        place = F.row_number().over(Window.orderBy("grp", "k"))  # max(anchors) rows
        numbered = first.select("window_id", "grp", "y_bin", place.alias("__place"))
        parts += [named(numbered.where(F.col("__place") <= n), f"anchor_{n}") for n in sorted(anchors)]
        pool = tested.join(first.select("grp").distinct(), "grp", "left_anti")
    parts.append(named(pool.where("y_bin = 0").orderBy(md5_order("window_id", seed), "window_id").limit(test_benign), "test_benign"))
    order = Window.partitionBy("y_cls").orderBy(md5_order("window_id", seed), "window_id")
    attack = pool.join(F.broadcast(novel.select(F.col("code").alias("y_cls"), "cls")), "y_cls").withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= test_class)
    parts.append(named(attack, F.concat(F.lit("test/"), "cls")))
    return reduce(DataFrame.unionByName, parts)


def verify_package(members: DataFrame, placed: DataFrame, novel: DataFrame) -> DataFrame:
    """(check_name, violations, ok): the checks that a package must pass before it is used.

    What a row alone shows is counted in one pass, what its group shows in a second over the table of groups.
    """
    codes = novel.select(F.col("code").alias("__code"), F.concat(F.lit("test/"), "cls").alias("set_name"))
    rows = members.select("set_name", "window_id").join(placed, "window_id").crossJoin(F.broadcast(_mask(novel))).join(F.broadcast(codes), "set_name", "left")
    name = F.col("set_name")
    train, val, anchor, test = name == "train", name == "val", F.startswith(name, F.lit("anchor_")), F.startswith(name, F.lit("test"))
    learned, wrong_class = train | val, F.coalesce(F.col("__code") != F.col("y_cls"), F.lit(True))
    of_row = {
        "learned_in_train": F.count_if(learned & (F.col("split") != TRAIN)),
        "no_novel_flow_learned": F.count_if(learned & _touched()),
        "novel_class_not_learned": F.count_if(learned & bitset.has(F.col("__novel"), F.col("y_cls"))),
        "val_has_both_labels": F.lit(2) - F.count_distinct(F.when(val, F.col("y_bin"))),
        "tested_in_test": F.count_if(test & (F.col("split") != TEST)),
        "anchors_benign": F.count_if(anchor & (F.col("y_bin") != 0)),
        "test_benign_is_benign": F.count_if((name == "test_benign") & (F.col("y_bin") != 0)),
        "class_sets_hold_their_class": F.count_if(F.startswith(name, F.lit("test/")) & wrong_class),
    }
    groups = rows.groupBy("grp").agg(*[F.count_if(kind).alias(n) for n, kind in (("train", train), ("val", val), ("anchor", anchor), ("test", test))])
    last = groups.agg(F.max(F.when(F.col("train") > 0, F.col("grp"))).alias("__last"))
    of_group = {
        "head_and_tail_apart": F.count_if((F.col("train") > 0) & (F.col("val") > 0)),
        "tail_after_head": F.sum(F.when(F.col("grp") <= F.col("__last"), F.col("val")).otherwise(0)),
        "test_without_anchor_groups": F.sum(F.when(F.col("anchor") > 0, F.col("test")).otherwise(0)),
    }

    def counted(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
        one = df.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(n) for n, v in checks.items()])
        return one.unpivot([], list(checks), "check_name", "violations").withColumn("ok", F.col("violations") == 0)

    anchors = rows.where(anchor).select("set_name", "window_id")  # as many as the anchors asked for
    largest = anchors.groupBy("set_name").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("set_name", F.struct("n", "set_name")).alias("__largest"))
    inside = anchors.crossJoin(F.broadcast(largest)).groupBy("window_id").agg(F.count_if(name == F.col("__largest")).alias("n"))
    empty = check(codes.join(members.select("set_name").distinct(), "set_name", "left_anti"), "class_sets_not_empty")
    return together(counted(rows, of_row), counted(groups.crossJoin(F.broadcast(last)), of_group), check(inside.where("n = 0"), "anchors_nested"), empty, check(members.groupBy("set_name", "window_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "no_window_twice"))
