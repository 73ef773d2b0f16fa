"""Result-cube analytics over long (cls, detector, seed, auc) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.operators.metrics import spearman
from noveltybench.operators.verify import check


def nest_runs(cube: DataFrame) -> DataFrame:
    """One run record a seed: detector -> class -> area, as nested maps."""
    inner = cube.groupBy("seed", "detector").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cls").cast("string"), "auc"))).alias("by_class"))
    return inner.groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("detector", "by_class"))).alias("auc"))


def runs_to_long(runs: DataFrame) -> DataFrame:
    """(cls, detector, seed, auc) of nested run records."""
    outer = runs.select("seed", F.explode("auc").alias("detector", "by_class"))
    return outer.select("seed", "detector", F.explode("by_class").alias("cls", "auc")).withColumn("cls", F.col("cls").cast("int"))


def aggregate_points(cube: DataFrame) -> DataFrame:
    """Mean, seed spread, share below one half and inversion flag of each (class, detector)."""
    return cube.groupBy("cls", "detector").agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"), F.avg((F.col("auc") < 0.5).cast("int")).alias("below_half"), (F.avg("auc") < 0.5).alias("inverted"))


def family_matrix(cube: DataFrame, family_of: dict[str, str]) -> DataFrame:
    """(cls, seed, family, value): the mean of a family's detectors."""
    pairs = F.create_map(*[F.lit(x) for kv in family_of.items() for x in kv])
    return cube.withColumn("family", F.element_at(pairs, F.col("detector"))).groupBy("cls", "seed", "family").agg(F.avg("auc").alias("value"))


def family_contrast(families: DataFrame, a: str, b: str) -> DataFrame:
    """(cls, seed, difference) of two families on the same unit and seed."""
    left = families.where(F.col("family") == a).select("cls", "seed", F.col("value").alias("__a"))
    right = families.where(F.col("family") == b).select("cls", "seed", F.col("value").alias("__b"))
    return left.join(right, ["cls", "seed"]).select("cls", "seed", (F.col("__a") - F.col("__b")).alias("difference"))


def family_leader(families: DataFrame) -> DataFrame:
    means = families.groupBy("cls", "family").agg(F.avg("value").alias("value"))
    return means.groupBy("cls").agg(F.max_by("family", "value").alias("leader"))


def pool_by_dimension(cube: DataFrame) -> DataFrame:
    """Means over all points, by class and by detector, from one pass over grouping sets."""
    pooled = cube.groupingSets([[F.col("cls")], [F.col("detector")], []], F.col("cls"), F.col("detector")).agg(F.avg("auc").alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping("cls").alias("__c"), F.grouping("detector").alias("__d"))
    dimension = F.when(F.col("__c") == 0, "class").when(F.col("__d") == 0, "detector").otherwise("all")
    return pooled.select(dimension.alias("dimension"), F.coalesce(F.col("cls").cast("string"), "detector", F.lit("all")).alias("member"), "mean", "n")


def protocol_means(cube: DataFrame, a: str, b: str) -> DataFrame:
    """(detector, a, b): mean area under two protocols."""
    return cube.groupBy("detector").agg(F.avg(F.when(F.col("protocol") == a, F.col("auc"))).alias("a"), F.avg(F.when(F.col("protocol") == b, F.col("auc"))).alias("b"))


def protocol_agreement(means: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How far two protocols agree on a table of detectors: one row, or one for each value of the keys."""
    keys = keys or []
    delta = F.col("b") - F.col("a")
    whole = means.groupBy(*keys).agg(
        F.avg(delta).alias("mean_delta"),
        F.avg(F.abs(delta)).alias("mean_abs_delta"),
        F.max(F.abs(delta)).alias("max_abs_delta"),
        F.percentile(delta, 0.5).alias("median_delta"),
        (F.max_by("detector", "a") == F.max_by("detector", "b")).alias("same_winner"),
        (F.max("b") - F.max_by("b", "a")).alias("regret"),
        F.count_if((F.col("a") < 0.5) != (F.col("b") < 0.5)).alias("side_flips"),
    )
    other = means.select(*keys, F.col("detector").alias("__d"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    pairs = means.join(other, keys).where(F.col("detector") < F.col("__d")) if keys else means.join(other, F.col("detector") < F.col("__d"))
    discordant = pairs.groupBy(*keys).agg(F.count_if((F.col("a") - F.col("__a")) * (F.col("b") - F.col("__b")) < 0).alias("discordant"))
    return whole.join(discordant, keys) if keys else whole.crossJoin(F.broadcast(discordant))


def agreement_ranks(means: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What choosing by protocol a costs under protocol b, from (keys, detector, family, a, b, c, d): one row, or one a key.

    a and b are a measure under either protocol, c and d a second one (a rate at a fixed false-alarm rate, say).  Ranks run
    from 1 for the greatest value, ties by detector name.  ``pick`` is the detector that leads under a.
    """
    keys = keys or []

    def rank(value: str, name: str = "detector") -> Column:
        return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), name))

    ranked = means.withColumn("__ra", rank("a")).withColumn("__rb", rank("b"))  # a table of detectors
    shift = F.abs(F.col("__ra") - F.col("__rb"))

    def of(place: str, value: str) -> Column:
        return F.max(F.when(F.col(place) == 1, F.col(value)))

    whole = ranked.groupBy(*keys).agg(
        F.avg(shift).alias("mean_rank_shift"),
        F.max(shift).alias("max_rank_shift"),
        F.count_if((F.col("a") - 0.5) * (F.col("b") - 0.5) < 0).alias("chance_side_flips"),
        of("__ra", "detector").alias("pick"),
        of("__ra", "__rb").alias("pick_rank"),
        of("__ra", "b").alias("pick_value"),
        of("__ra", "d").alias("pick_second"),
        (of("__rb", "b") - of("__ra", "b")).alias("regret"),
        (of("__rb", "d") - of("__ra", "d")).alias("second_regret"),
        F.avg(F.col("d") - F.col("c")).alias("mean_second_delta"),
        F.avg(F.abs(F.col("d") - F.col("c"))).alias("mean_abs_second_delta"),
    )
    families = means.groupBy(*keys, "family").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn("__ra", rank("a", "family")).withColumn("__rb", rank("b", "family"))
    leaders = families.groupBy(*keys).agg(of("__ra", "family").alias("leader_a"), of("__rb", "family").alias("leader_b")).withColumn("leader_flip", F.col("leader_a") != F.col("leader_b"))
    return whole.join(leaders, keys) if keys else whole.crossJoin(leaders)


def agreement_rollup(agreements: DataFrame) -> DataFrame:
    """One row over configurations (their agreement and rho): counts, ranges and medians."""
    return agreements.agg(
        F.count(F.lit(1)).alias("configurations"),
        F.count_if(F.col("mean_delta") < 0).alias("lower_under_b"),
        F.count_if(~F.col("same_winner")).alias("winner_flips"),
        F.sum("side_flips").alias("side_flips"),
        F.sum("discordant").alias("discordant"),
        F.min("rho").alias("rho_low"),
        F.max("rho").alias("rho_high"),
        F.percentile("rho", 0.5).alias("rho_median"),
        F.percentile("regret", 0.5).alias("regret_median"),
        F.max("regret").alias("regret_max"),
        F.min("mean_abs_delta").alias("mean_abs_delta_low"),
        F.max("mean_abs_delta").alias("mean_abs_delta_high"),
        F.max("max_abs_delta").alias("max_abs_delta"),
    )


def agreement_replicates(cells: DataFrame, units_a: DataFrame, units_b: DataFrame, seeds: DataFrame) -> DataFrame:
    """(rep, detector, a, b): means of detectors over drawn units of two protocols and drawn seeds, the same for both.

    ``cells`` has cls, detector, seed and auc; the draws have rep, times and cls or seed.
    """

    def side(units: DataFrame, name: str) -> DataFrame:
        w = F.col("times") * F.col("__seed_times")
        drawn = cells.join(units, "cls").join(seeds.withColumnRenamed("times", "__seed_times"), ["rep", "seed"])
        return drawn.groupBy("rep", "detector").agg((F.sum(w * F.col("auc")) / F.sum(w)).alias(name))

    return side(units_a, "a").join(side(units_b, "b"), ["rep", "detector"])


def elapsed(runs: DataFrame) -> DataFrame:
    """One row of hours: separate runs add up; runs of one training (eval_id, seed) count once, by their longest time."""
    shared = runs.where("kind = 'shared'").groupBy("eval_id", "seed").agg(F.max("wall_seconds").alias("wall_seconds"))
    both = runs.where("kind = 'separate'").select("kind", "wall_seconds").unionByName(shared.select(F.lit("shared").alias("kind"), "wall_seconds"))
    hours = both.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("wall_seconds"))), F.lit(0.0)).alias(k) for k in ("separate", "shared")])
    return hours.select((F.col("separate") / 3600).alias("separate_hours"), (F.col("shared") / 3600).alias("shared_hours"), ((F.col("separate") + F.col("shared")) / 3600).alias("total_hours"))


def dose_response(sweep: DataFrame, variants: DataFrame) -> DataFrame:
    """(dataset, rho, variant, ratio, f1_drop, falls, holds, both) of a dose sweep and the variants that should resist it.

    ``sweep`` has dataset, gamma, d_prime and macro_f1 (in per cent) of runs; ``variants`` dataset, tau, kappa,
    validation, d_prime and macro_f1.  The variant of the best mean validation score is taken, the smaller tau, then
    kappa, at a tie.  ``falls``: d' falls with the dose (rank correlation -0.8 at most); ``holds``: the variant keeps
    0.8 of the undosed d' and loses less than a point of F1.
    """
    doses = sweep.groupBy("dataset", "gamma").agg(F.avg("d_prime").alias("d_prime"), F.avg("macro_f1").alias("macro_f1"))
    rho = spearman(doses, ["dataset"], "gamma", "d_prime", 1)
    undosed = doses.where("gamma = 0").select("dataset", F.col("d_prime").alias("d0"), F.col("macro_f1").alias("f0"))
    means = variants.groupBy("dataset", "tau", "kappa").agg(F.avg("validation").alias("v"), F.avg("d_prime").alias("d_prime"), F.avg("macro_f1").alias("macro_f1"))
    best = means.groupBy("dataset").agg(F.min_by(F.struct("tau", "kappa", "d_prime", "macro_f1"), F.struct(-F.col("v"), "tau", "kappa")).alias("best"))
    joined = rho.join(undosed, "dataset").join(best, "dataset")
    ratio, drop = F.col("best.d_prime") / F.col("d0"), F.col("f0") - F.col("best.macro_f1")
    falls, holds = F.coalesce(F.col("rho") <= -0.8, F.lit(False)), (F.col("best.d_prime") >= 0.8 * F.col("d0")) & (drop < 1)
    return joined.select("dataset", "rho", F.col("best.tau").alias("tau"), F.col("best.kappa").alias("kappa"), ratio.alias("ratio"), drop.alias("f1_drop"), falls.alias("falls"), holds.alias("holds"), (falls & holds).alias("both"))


def inversion_table(cube: DataFrame) -> DataFrame:
    """Counts of predicted (first seed) against observed (other seeds) inversions."""
    points = cube.groupBy("cls", "detector").agg((F.avg(F.when(F.col("seed") == 0, F.col("auc"))) < 0.5).alias("predicted"), (F.avg(F.when(F.col("seed") > 0, F.col("auc"))) < 0.5).alias("observed"))
    return points.groupBy("predicted", "observed").agg(F.count(F.lit(1)).alias("n"))


def band_shares(points: DataFrame, low: float, high: float) -> DataFrame:
    m = F.col("mean")
    return points.groupBy("detector").agg(F.avg(m.between(low, high).cast("int")).alias("in_band"), F.avg((m < low).cast("int")).alias("below"), F.avg((m > high).cast("int")).alias("above"), F.percentile("mean", 0.5).alias("median"))


def complete_grid(cube: DataFrame, keys: list[str], seed: str, seeds: int) -> DataFrame:
    """Missing and surplus cells of the grid of all key values and seeds."""
    grid = cube.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(cube.select(k).distinct())
    grid = grid.crossJoin(cube.sparkSession.range(seeds).withColumnRenamed("id", seed))
    by = [*keys, seed]
    missing = grid.join(cube, by, "left_anti").select(*by)
    return check(missing.unionByName(cube.select(*by).join(grid, by, "left_anti")), "complete_grid")
