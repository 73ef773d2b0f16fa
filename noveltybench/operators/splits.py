"""Block-level splits, exact-ratio samples and folds over a window table.

A window table has grp, k, y_bin, y_cls and class_mask.  Splits are decided on
the small table of groups and joined back; samples are ranked by an md5 order
inside (set, label), so the same rows come out in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.functions import bitset
from noveltybench.functions.sampling import md5_order

TRAIN, GAP, VAL, TEST = "train", "gap", "val", "test"


def group_sizes(windows: DataFrame) -> DataFrame:
    return windows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def _cumulative(sizes: DataFrame, order: Column, gap: bool, train: float = 0.6, val: float = 0.8) -> DataFrame:
    """(grp, n, split): train while less than ``train`` of all windows came before, then a gap group, then val, then test.

    The gap group counts among the windows that came before a val group.
    """
    w = Window.orderBy(order, "grp")
    total = F.sum("n").over(Window.partitionBy())
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("__before", before).withColumn("__total", total).withColumn("__train", F.col("__before") < F.lit(train) * F.col("__total"))
    first_other = F.sum((~F.col("__train")).cast("int")).over(w) == 1
    split = F.when(F.col("__train"), TRAIN)
    if gap:
        split = split.when(first_other, GAP)
    return ranked.select("grp", "n", split.when(F.col("__before") < F.lit(val) * F.col("__total"), VAL).otherwise(TEST).alias("split"))


def split_temporal_gap(windows: DataFrame) -> DataFrame:
    """(grp, n, split) in time order with one gap group after train."""
    return _cumulative(group_sizes(windows), F.col("grp"), True)


def split_grouped_random(windows: DataFrame, seed: int) -> DataFrame:
    """(grp, n, split) on a seeded order of groups, without a gap."""
    return _cumulative(group_sizes(windows), md5_order("grp", seed), False)


def rolling_cut_split(windows: DataFrame, cuts: list[float]) -> DataFrame:
    """(cut, grp, n, split) for each cut fraction: train before the cut, one gap group, test after; a cut without test is an error."""
    sizes = group_sizes(windows).crossJoin(F.broadcast(windows.sparkSession.createDataFrame([(c,) for c in cuts], "cut double")))
    w = Window.partitionBy("cut").orderBy("grp")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("__train", before < F.col("cut") * F.sum("n").over(Window.partitionBy("cut")))
    other = F.sum((~F.col("__train")).cast("int")).over(w)
    split = F.when(F.col("__train"), TRAIN).when(other == 1, GAP).otherwise(TEST)
    tested = F.max(other).over(Window.partitionBy("cut")) > 1
    return ranked.select("cut", "grp", "n", F.when(~tested, F.raise_error(F.lit("a cut leaves no test group")).cast("string")).otherwise(split).alias("split"))


def with_split(windows: DataFrame, split: DataFrame) -> DataFrame:
    return windows.join(split.select("grp", "split"), "grp")


def split_empty_guard(split: DataFrame) -> DataFrame:
    """(split, windows) of train, val and test; an error if one is empty."""
    needed = split.sparkSession.createDataFrame([(s,) for s in (TRAIN, VAL, TEST)], "split string")
    found = needed.join(split.groupBy("split").agg(F.sum("n").alias("windows")), "split", "left")
    return found.select("split", F.when(F.col("windows").isNull(), F.raise_error(F.concat(F.lit("empty split: "), F.col("split"))).cast("long")).otherwise(F.col("windows")).alias("windows"))


def split_composition(windows: DataFrame) -> DataFrame:
    """Windows of each majority class by split, and whether the class is in val or test but not in train."""
    counts = windows.groupBy("y_cls").pivot("split", [TRAIN, GAP, VAL, TEST]).count().fillna(0)
    return counts.withColumn("test_only", (F.col(TEST) > 0) & (F.col(TRAIN) == 0)).withColumn("val_only", (F.col(VAL) > 0) & (F.col(TRAIN) == 0))


def balance_exact_ratio(rows: DataFrame, ratio: int, cap: int, seed: int, by: list[str] | None = None, key: str = "window_id") -> DataFrame:
    """Rows with exactly ``ratio`` benign rows for each attack row and at most ``cap`` in all, drawn without replacement.

    ``by`` names columns inside which this holds.  Quotas come from counts alone.
    """
    by = by or []
    counts = rows.groupBy(*by).agg(F.sum((F.col("y_bin") == 1).cast("long")).alias("__a"), F.sum((F.col("y_bin") == 0).cast("long")).alias("__b"))
    attack = F.least(F.col("__a"), F.lit(cap // (1 + ratio)), F.floor(F.col("__b") / F.lit(ratio)))
    quotas = counts.select(*by, attack.cast("long").alias("__na"), (attack * ratio).cast("long").alias("__nb"))
    rank = F.row_number().over(Window.partitionBy(*by, "y_bin").orderBy(md5_order(key, seed), key))
    # No quota is above this; as a literal it cuts every task's rows before the shuffle.
    ranked = rows.withColumn("__rank", rank).where(F.col("__rank") <= cap // (1 + ratio) * max(ratio, 1))
    joined = ranked.join(quotas, by) if by else ranked.crossJoin(F.broadcast(quotas))
    return joined.where(F.col("__rank") <= F.when(F.col("y_bin") == 1, F.col("__na")).otherwise(F.col("__nb"))).drop("__rank", "__na", "__nb")


def natural_prior_sample(rows: DataFrame, cap: int, seed: int, key: str = "window_id") -> DataFrame:
    """A uniform subsample of at most ``cap`` rows."""
    return rows.orderBy(md5_order(key, seed), key).limit(cap)


def make_sets(windows: DataFrame, seed: int, train_ratio: int = 1, eval_ratio: int = 5, train_cap: int = 14_000, eval_cap: int = 3_000, natural_cap: int = 20_000) -> DataFrame:
    """(set_name, window_id, y_bin): balanced train, val and test sets and a natural test set."""
    parts = [(TRAIN, train_ratio, train_cap), (VAL, eval_ratio, eval_cap), (TEST, eval_ratio, eval_cap)]
    sets = [balance_exact_ratio(windows.where(F.col("split") == s), r, c, seed).select(F.lit(s).alias("set_name"), "window_id", "y_bin") for s, r, c in parts]
    natural = natural_prior_sample(windows.where(F.col("split") == TEST), natural_cap, seed).select(F.lit("test_natural").alias("set_name"), "window_id", "y_bin")
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(natural)


def has_class(mask: str, code: Column) -> Column:
    """Does the window's bitset hold the class?"""
    return bitset.has(F.col(mask), code)


def loaco_folds(windows: DataFrame, classes: DataFrame, seed: int, min_train: int = 200, train_ratio: int = 1, eval_ratio: int = 5, train_cap: int = 14_000, eval_cap: int = 3_000) -> DataFrame:
    """(fold, part, window_id, y_bin) of leave-one-attack-class-out folds.

    Train and val lose every window that contains the class; test keeps benign windows and those whose majority
    class it is.  A class with fewer than ``min_train`` train windows has no fold.
    """
    attack = classes.where("code > 0").select(F.col("code").alias("fold"))
    enough = windows.where(F.col("split") == TRAIN).join(F.broadcast(attack), has_class("class_mask", F.col("fold"))).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_train).select("fold")
    spread = windows.where(F.col("split").isin(TRAIN, VAL, TEST)).crossJoin(F.broadcast(enough))
    fits = F.when(F.col("split") == TEST, (F.col("y_bin") == 0) | (F.col("y_cls") == F.col("fold"))).otherwise(~has_class("class_mask", F.col("fold")))
    rows = spread.where(fits)
    train = balance_exact_ratio(rows.where(F.col("split") == TRAIN), train_ratio, train_cap, seed, ["fold", "split"])
    rest = balance_exact_ratio(rows.where(F.col("split") != TRAIN), eval_ratio, eval_cap, seed, ["fold", "split"])
    return train.unionByName(rest).select("fold", F.col("split").alias("part"), "window_id", "y_bin")


def loaco_feasibility(folds: DataFrame, classes: DataFrame) -> DataFrame:
    """(fold, train, val, test, feasible) of every attack class."""
    counts = folds.groupBy("fold").pivot("part", [TRAIN, VAL, TEST]).count()
    found = classes.where("code > 0").select(F.col("code").alias("fold")).join(counts, "fold", "left").fillna(0)
    return found.withColumn("feasible", (F.col(TRAIN) > 0) & (F.col(VAL) > 0) & (F.col(TEST) > 0))


def nn_class_discovery(windows: DataFrame, classes: DataFrame, least: int = 20) -> DataFrame:
    """(code, n_train, n_test, status) of classes that occur in test but not in train: novel from ``least`` windows on, else near."""
    spread = windows.join(F.broadcast(classes.where("code > 0").select("code")), has_class("class_mask", F.col("code")))
    counts = spread.groupBy("code").agg(F.sum((F.col("split") == TRAIN).cast("long")).alias("n_train"), F.sum(((F.col("split") == TEST) & (F.col("y_cls") == F.col("code"))).cast("long")).alias("n_test"))
    return counts.where("n_train = 0 and n_test > 0").withColumn("status", F.when(F.col("n_test") >= least, "novel").otherwise("near"))


def natural_novelty_sets(windows: DataFrame, novel: DataFrame, seed: int, train_ratio: int = 1, eval_ratio: int = 5, train_cap: int = 14_000, eval_cap: int = 3_000) -> DataFrame:
    """(part, cls, window_id, y_bin): train and val without any novel class, one test set for each novel class."""
    mask = novel.agg(bitset.gathered(F.col("code")).alias("__novel"))  # one row
    clean = windows.crossJoin(F.broadcast(mask)).where(~bitset.overlaps(F.col("class_mask"), F.col("__novel"))).drop("__novel")
    train = balance_exact_ratio(clean.where(F.col("split") == TRAIN), train_ratio, train_cap, seed).select(F.lit(TRAIN).alias("part"), F.lit(0).alias("cls"), "window_id", "y_bin")
    val = balance_exact_ratio(clean.where(F.col("split") == VAL), eval_ratio, eval_cap, seed).select(F.lit(VAL).alias("part"), F.lit(0).alias("cls"), "window_id", "y_bin")
    spread = windows.where(F.col("split") == TEST).crossJoin(F.broadcast(novel.select(F.col("code").alias("cls")))).where((F.col("y_bin") == 0) | (F.col("y_cls") == F.col("cls")))
    test = balance_exact_ratio(spread, eval_ratio, eval_cap, seed, ["cls"]).select(F.lit(TEST).alias("part"), "cls", "window_id", "y_bin")
    return train.unionByName(val).unionByName(test)


def rolling_feasibility(windows: DataFrame, cut_split: DataFrame, classes: DataFrame, least: int = 20) -> DataFrame:
    """(cut, novel, near, train_benign, train_attack, test_benign, test_attack, feasible) of each cut."""
    placed = windows.join(cut_split.select("cut", "grp", "split"), "grp")
    spread = placed.join(F.broadcast(classes.where("code > 0").select("code")), has_class("class_mask", F.col("code")))
    per_class = spread.groupBy("cut", "code").agg(F.sum((F.col("split") == TRAIN).cast("long")).alias("n_train"), F.sum(((F.col("split") == TEST) & (F.col("y_cls") == F.col("code"))).cast("long")).alias("n_test"))
    new = per_class.groupBy("cut").agg(
        F.sum((F.col("n_train").eqNullSafe(0) & (F.col("n_test") >= least)).cast("long")).alias("novel"),
        F.sum((F.col("n_train").eqNullSafe(0) & F.col("n_test").between(1, least - 1)).cast("long")).alias("near"),
    )

    def count(split: str, label: int) -> Column:
        return F.sum(((F.col("split") == split) & (F.col("y_bin") == label)).cast("long"))

    sides = placed.groupBy("cut").agg(count(TRAIN, 0).alias("train_benign"), count(TRAIN, 1).alias("train_attack"), count(TEST, 0).alias("test_benign"), count(TEST, 1).alias("test_attack"))
    joined = sides.join(new, "cut", "left").fillna(0, ["novel", "near"])
    return joined.withColumn("feasible", (F.col("novel") > 0) & (F.col("train_benign") > 0) & (F.col("train_attack") > 0) & (F.col("test_benign") > 0))


def head_tail_train(windows: DataFrame, share: float = 0.8) -> DataFrame:
    """(grp, n, side) of the train groups: whole groups up to ``share`` of the windows are the head, the rest the tail."""
    sizes = group_sizes(windows.where(F.col("split") == TRAIN))
    before = F.coalesce(F.sum("n").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("__before", before).withColumn("__total", F.sum("n").over(Window.partitionBy())).select("grp", "n", F.when(F.col("__before") < F.lit(share) * F.col("__total"), "head").otherwise("tail").alias("side"))


def capture_days(blocks: DataFrame, gap_blocks: int = 36, block: str = "block") -> DataFrame:
    """``blocks`` with ``day``: a new number after each gap of at least ``gap_blocks`` empty blocks."""
    w = Window.orderBy(block)
    new = F.coalesce((F.col(block) - F.lag(block).over(w) >= gap_blocks).cast("int"), F.lit(0))
    return blocks.withColumn("__new", new).withColumn("day", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def split_per_day_shuffle(blocks: DataFrame, seed: int, block: str = "block") -> DataFrame:
    """``blocks`` with a 60/20/20 split inside each day on a seeded order; sizes round half up."""
    place = F.row_number().over(Window.partitionBy("day").orderBy(md5_order(block, seed), block))
    n = F.count(F.lit(1)).over(Window.partitionBy("day"))
    train, val = F.floor(F.lit(0.6) * n + 0.5), F.floor(F.lit(0.2) * n + 0.5)
    return blocks.withColumn("split", F.when(place <= train, TRAIN).when(place <= train + val, VAL).otherwise(TEST))


def purge_adjacent_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    """``blocks`` with ``purged``: train or val next to a test block of the day, then surviving train next to surviving val."""

    def beside(rows: DataFrame) -> DataFrame:
        return rows.select("day", F.explode(F.array(F.col(block) - 1, F.col(block) + 1)).alias(block)).distinct()

    near_test = beside(blocks.where(F.col("split") == TEST)).withColumn("__by_test", F.lit(True))
    one = blocks.join(near_test, ["day", block], "left").withColumn("__by_test", F.coalesce("__by_test", F.lit(False)) & F.col("split").isin(TRAIN, VAL))
    near_val = beside(one.where((F.col("split") == VAL) & ~F.col("__by_test"))).withColumn("__by_val", F.lit(True))
    two = one.join(near_val, ["day", block], "left")
    return two.withColumn("purged", F.col("__by_test") | (F.coalesce("__by_val", F.lit(False)) & (F.col("split") == TRAIN) & ~F.col("__by_test"))).drop("__by_test", "__by_val")


def split_shares(split: DataFrame) -> DataFrame:
    """(split, n, share) of a (grp, n, split) table."""
    counts = split.groupBy("split").agg(F.sum("n").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
