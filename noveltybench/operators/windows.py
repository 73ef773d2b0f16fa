"""Time blocks, overlapping count windows, window labels and duplicate windows.

A *flow* table has a time, a row id that breaks ties, a class name and feature
columns.  A *window* is a run of ``size`` consecutive flows of one block, every
``stride`` flows; a block's incomplete tail makes no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.functions import bitset
from noveltybench.operators.ranks import fitting, running

BENIGN = "Benign"


def placed_by_time(flows: DataFrame, time: str = "t_ms", row_id: str = "row_id") -> DataFrame:
    """``flows`` with ``place``, the place from 1 in the order of time and row id.

    Flows before a time are counted by distinct times, dealt to buckets; only flows of one time share a sort.
    """
    levels = flows.groupBy(time).agg(F.count(F.lit(1)).alias("__n"))
    before = running(levels, [], time, ["__n"]).select(time, "__n_before")
    among = F.row_number().over(Window.partitionBy(time).orderBy(row_id))
    return flows.join(before, time).withColumn("place", (F.col("__n_before") + among).cast("long")).drop("__n_before")


def time_blocks(flows: DataFrame, block_ms: float, time: str = "t_ms") -> DataFrame:
    """``flows`` with ``grp``: dense number of its non-empty block of ``block_ms`` since the first time.

    A missing or NaN time is an error.  Only the table of blocks is ranked, so no row-scale sort is needed.
    """
    checked = flows.withColumn(time, F.when(F.col(time).isNull() | F.isnan(time), F.raise_error(F.lit("missing time")).cast("double")).otherwise(F.col(time)))
    first = flows.agg(F.min(time).alias("__first"))
    placed = checked.crossJoin(F.broadcast(first)).withColumn("__block", F.floor((F.col(time) - F.col("__first")) / F.lit(float(block_ms)))).drop("__first")
    blocks = placed.select("__block").distinct().withColumn("grp", (F.row_number().over(Window.orderBy("__block")) - 1).cast("int"))
    return placed.join(blocks, "__block").withColumnRenamed("__block", "block")


def class_table(flows: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, code): Benign (any case) is 0, others 1, 2, ... by name; a missing class is an error."""
    names = flows.select(F.when(F.col(cls).isNull(), F.raise_error(F.lit("missing class")).cast("string")).otherwise(F.col(cls)).alias(cls)).distinct()
    benign = F.lower(cls) == BENIGN.lower()
    others = names.where(~benign).withColumn("code", F.row_number().over(Window.orderBy(cls)).cast("int"))
    return names.where(benign).withColumn("code", F.lit(0)).unionByName(others)


def class_codes(flows: DataFrame, cls: str = "cls") -> DataFrame:
    """``flows`` with the class code."""
    return flows.join(class_table(flows, cls), cls)


def numbered(flows: DataFrame, time: str = "t_ms", row_id: str = "row_id", slice_ms: float = 225_000.0) -> DataFrame:
    """``flows`` with ``rn``, the place of a flow in its block from 0.

    Slices of a block are put in order by tasks of their own; counts of the slices before carry over.  Blocks that a task
    can sort whole need no slices: the largest is counted first.
    """
    if fitting(flows, ["grp"]) == 1:
        return flows.withColumn("rn", (F.row_number().over(Window.partitionBy("grp").orderBy(time, row_id)) - 1).cast("long"))
    sliced = flows.withColumn("__slice", F.floor(F.col(time) / F.lit(slice_ms)))
    counts = sliced.groupBy("grp", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("grp").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("grp", "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("grp", "__slice").orderBy(time, row_id)) - 1
    return sliced.withColumn("__inside", inside).join(before, ["grp", "__slice"]).withColumn("rn", (F.col("__inside") + F.col("__before")).cast("long")).select(*flows.columns, "rn")


def count_windows(flows: DataFrame, size: int, stride: int) -> DataFrame:
    """Numbered flows once for each window they belong to, with window number ``k`` and place ``pos`` in it.

    Block sizes tell which windows are whole, so nothing is counted after the explosion.
    """
    n = flows.groupBy("grp").agg(F.count(F.lit(1)).alias("__n"))
    last = F.floor((F.col("__n") - size) / F.lit(stride))
    lowest = F.greatest(F.lit(0), F.ceil((F.col("rn") - (size - 1)) / F.lit(stride)))
    highest = F.least(F.floor(F.col("rn") / F.lit(stride)), last)
    spread = flows.join(n, "grp").where((F.col("__n") >= size) & (lowest <= highest)).withColumn("k", F.explode(F.sequence(lowest, highest)))
    return spread.withColumn("pos", (F.col("rn") - F.col("k") * stride).cast("int")).drop("__n")


def block_starts(flows: DataFrame) -> DataFrame:
    """(grp, n, before): flows of a block and of all blocks before it; one row a block."""
    n = flows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("before", F.sum("n").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])


def window_labels(exploded: DataFrame, size: int, code: str = "code") -> DataFrame:
    """(grp, k, start_rn, y_bin, y_cls, n_modes, purity, class_mask, n_attack) of each window.

    y_cls is the most frequent attack class (the lower code at a tie), 0 without attacks; purity is the share of
    flows that carry it; class_mask is the bitset (array of longs) of the classes that occur, of any number.
    """
    counts = exploded.groupBy("grp", "k", code).agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"))
    attack = F.col(code) > 0
    best = F.max(F.when(attack, F.struct(F.col("n"), (-F.col(code)).alias("low"))))
    per = counts.groupBy("grp", "k").agg(
        F.min("first").alias("start_rn"),
        best.alias("best"),
        F.collect_list(F.when(attack, F.col("n"))).alias("ns"),
        F.sum(F.when(attack, F.col("n")).otherwise(0)).alias("n_attack"),
        F.collect_list(code).alias("codes"),
    )
    y_cls = F.coalesce(-F.col("best.low"), F.lit(0)).cast("int")
    return per.select(
        "grp",
        F.col("k").cast("long").alias("k"),
        "start_rn",
        (F.col("n_attack") > 0).cast("int").alias("y_bin"),
        y_cls.alias("y_cls"),
        F.when(F.col("n_attack") > 0, F.size(F.filter("ns", lambda n: n == F.col("best.n")))).otherwise(0).cast("int").alias("n_modes"),
        (F.coalesce(F.col("best.n"), F.lit(size)) / F.lit(float(size))).alias("purity"),
        bitset.from_bits(F.col("codes")).alias("class_mask"),
        F.col("n_attack").cast("long").alias("n_attack"),
    )


def window_stats(flows: DataFrame, size: int, stride: int) -> DataFrame:
    """One row: flows in no window, blocks, blocks shorter than a window, windows."""
    n = flows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    windows = F.when(F.col("n") >= size, F.floor((F.col("n") - size) / F.lit(stride)) + 1).otherwise(0)
    tail = F.when(F.col("n") >= size, F.col("n") - ((windows - 1) * stride + size)).otherwise(F.col("n"))
    return n.agg(
        F.sum(tail).cast("long").alias("flows_in_no_window"),
        F.count(F.lit(1)).alias("groups"),
        F.sum((F.col("n") < size).cast("long")).alias("short_groups"),
        F.sum(windows).cast("long").alias("windows"),
    )


def window_hashes(exploded: DataFrame, columns: list[str]) -> DataFrame:
    """(grp, k, sha): SHA-256 of a canonical text of the window's rows in order, columns in the given order."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), row.alias("row"))))
    rows = exploded.groupBy("grp", F.col("k").cast("long").alias("k")).agg(ordered.alias("rows"))
    return rows.select("grp", "k", F.sha2(F.array_join(F.transform("rows", lambda r: r["row"]), ";"), 256).alias("sha"))


def dedupe_windows(windows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The earliest window of each hash.

    The first window is found by aggregation, so one hash with very many copies is no single sort group.
    """
    order = order or ["grp", "k"]
    first = windows.groupBy("sha").agg(F.min(F.struct(*order)).alias("__first")).select("sha", *[F.col(f"__first.{c}").alias(c) for c in order])
    return windows.join(first, ["sha", *order], "left_semi")


def dedupe_label_conflicts(windows: DataFrame) -> DataFrame:
    """One row: neighbouring copies, in order of start, with different binary labels."""
    inside = F.lag("y_bin").over(Window.partitionBy("sha", "grp").orderBy("k"))
    # Copies inside a block are compared there; only the first and last label of each block meet those of other blocks.
    blocks = windows.withColumn("__changed", (inside != F.col("y_bin")).cast("long")).groupBy("sha", "grp").agg(F.coalesce(F.sum("__changed"), F.lit(0)).alias("inside"), F.min_by("y_bin", "k").alias("first"), F.max_by("y_bin", "k").alias("last"))
    before = F.lag("last").over(Window.partitionBy("sha").orderBy("grp"))
    return blocks.withColumn("across", F.coalesce((before != F.col("first")).cast("long"), F.lit(0))).agg(F.coalesce(F.sum(F.col("inside") + F.col("across")), F.lit(0)).alias("conflicts"))


def family_table(classes: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(cls, family) of a map {family: classes}; every class must be mapped, and Benign to Benign."""
    if families.get(BENIGN) != [BENIGN]:
        raise ValueError("the family map must map Benign to Benign alone")
    family_of = {c: f for f, cs in families.items() for c in cs}
    pairs = F.create_map(*[F.lit(x) for kv in family_of.items() for x in kv])
    found = F.element_at(pairs, F.col("cls"))
    return classes.select("cls", F.when(found.isNull(), F.raise_error(F.concat(F.lit("class without a family: "), F.col("cls"))).cast("string")).otherwise(found).alias("family"))


def family_codes(flows: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """``flows`` with ``family`` and its code among the families."""
    mapped = flows.join(family_table(flows.select("cls").distinct(), families), "cls")
    codes = class_table(mapped, "family").withColumnRenamed("code", "family_code")
    return mapped.join(codes, "family")


def relabel_family(exploded: DataFrame, size: int) -> DataFrame:
    """Window labels under the family codes; an error if a binary label changes."""
    fine, coarse = window_labels(exploded, size), window_labels(exploded, size, "family_code")
    both = coarse.join(fine.select("grp", "k", F.col("y_bin").alias("__fine")), ["grp", "k"])
    ok = F.when(F.col("__fine") != F.col("y_bin"), F.raise_error(F.lit("a binary label changed")).cast("int")).otherwise(F.col("y_bin"))
    return both.withColumn("y_bin", ok).drop("__fine")


def materialize_windows(windows: DataFrame, flows: DataFrame, size: int, stride: int) -> DataFrame:
    """Window rows (grp, k, pos and the flow's columns) of chosen windows, by an equi-join on exploded places."""
    places = windows.select("grp", "k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos")).withColumn("rn", F.col("k") * stride + F.col("pos"))
    return places.join(flows, ["grp", "rn"])
