"""Fail-closed validators: each returns (check_name, violations, ok) rows; `enforce` raises on a failed one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.operators.splits import has_class


class CheckFailed(ValueError):
    """A validator found violations."""


def check(violating: DataFrame, name: str) -> DataFrame:
    """One row that counts the violating rows."""
    return violating.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations", (F.col("violations") == 0).alias("ok"))


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def enforce(checks: DataFrame) -> DataFrame:
    """The checks, or an error that names the failed ones."""
    failed = [(r["check_name"], r["violations"]) for r in checks.where(~F.col("ok")).collect()]
    if failed:
        raise CheckFailed(", ".join(f"{name}: {n} violations" for name, n in failed))
    return checks


def unique(rows: DataFrame, key: str, name: str) -> DataFrame:
    return check(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)


def disjoint(rows: DataFrame, key: str, split: str, name: str) -> DataFrame:
    """No key may occur in two splits."""
    return check(rows.groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b"), name)


def sets(members: DataFrame, windows: DataFrame, caps: dict[str, int], ratios: dict[str, int]) -> DataFrame:
    """No window twice in a set, sets inside their split, sizes within the caps, exact ratios."""
    placed = members.join(windows.select("window_id", "split"), "window_id")
    sizes = members.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_bin") == 0).alias("b"), F.count_if(F.col("y_bin") == 1).alias("a"))
    limits = members.sparkSession.createDataFrame([(s, c, ratios.get(s)) for s, c in caps.items()], "set_name string, cap long, ratio long")
    limited = sizes.join(F.broadcast(limits), "set_name")
    return together(
        check(members.groupBy("set_name", "window_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "no_window_twice"),
        check(placed.where(F.col("split") != F.replace("set_name", F.lit("_natural"), F.lit(""))), "right_split"),
        check(limited.where("n > cap"), "below_cap"),
        check(limited.where("b <> a * ratio"), "exact_ratio"),
    )


def loaco(folds: DataFrame, windows: DataFrame) -> DataFrame:
    placed = folds.drop("y_bin").join(windows, "window_id")
    return together(
        check(placed.where((F.col("part") != "test") & has_class("class_mask", F.col("fold"))), "class_absent"),
        check(placed.where("part <> split"), "part_is_split"),
        check(placed.where("part = 'test' and y_bin = 1 and y_cls <> fold"), "test_is_benign_or_held_out"),
    )


def natural_novelty(members: DataFrame, windows: DataFrame, novel: DataFrame) -> DataFrame:
    placed = members.drop("y_bin").join(windows, "window_id")
    learned = placed.where("part <> 'test'").crossJoin(F.broadcast(novel.select("code")))
    tested = members.where("part = 'test' and y_bin = 1").select(F.col("cls").alias("code"))
    return together(
        check(learned.where(has_class("class_mask", F.col("code"))), "class_absent"),
        check(placed.where("part <> split"), "part_is_split"),
        check(novel.select("code").join(tested, "code", "left_anti"), "class_tested"),
    )


def purge(blocks: DataFrame) -> DataFrame:
    """No kept train or val block beside a test block, no kept train block beside a kept val block."""

    def beside(rows: DataFrame) -> DataFrame:
        return rows.select("day", F.explode(F.array(F.col("block") - 1, F.col("block") + 1)).alias("block"))

    kept = blocks.where(~F.col("purged"))
    return together(
        check(kept.where("split <> 'test'").join(beside(blocks.where("split = 'test'")), ["day", "block"]), "kept_beside_test"),
        check(kept.where("split = 'train'").join(beside(kept.where("split = 'val'")), ["day", "block"]), "train_beside_val"),
    )


def single_provenance(runs: DataFrame, by: str) -> DataFrame:
    """(by, runs, commits, unclean, ok): the runs of an experiment must come from one clean commit, none of them a trial."""
    unclean = F.count_if(F.col("dirty") | F.col("smoke"))
    found = runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("code_commit").alias("commits"), unclean.alias("unclean"))
    return found.withColumn("ok", (F.col("commits") == 1) & (F.col("unclean") == 0))


def recorded_hashes(recorded: DataFrame, current: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(artefact, what, match) of recorded against current digests and row counts.

    match is null where a difference is documented in ``exceptions`` (artefact, what); an artefact on one side only
    doesn't match.
    """

    def long(side: DataFrame, name: str) -> DataFrame:
        return side.select("artefact", F.col("digest"), F.col("n").cast("string").alias("rows")).unpivot("artefact", ["digest", "rows"], "what", name)

    both = long(recorded, "then").join(long(current, "now"), ["artefact", "what"], "full_outer").join(F.broadcast(exceptions.withColumn("__e", F.lit(True))), ["artefact", "what"], "left")
    return both.select("artefact", "what", F.when(F.col("then").eqNullSafe(F.col("now")), True).when(F.col("__e"), F.lit(None)).otherwise(False).alias("match"))


def table_digest(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(artefact, n, digest) of each part of a table: the sum of its rows' hashes, whatever their order."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]))
    digest = F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.groupBy(F.col(by).alias("artefact")).agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))
