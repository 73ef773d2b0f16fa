"""Ranking metrics, resampling and agreement statistics over long score tables (keys, y in {0, 1}, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.functions.sampling import md5_draw
from noveltybench.operators.ranks import midranks, normal_cdf, quantile, running

#: Two-sided 95 % points of the t distribution by degrees of freedom (fixed values).
T_975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262}


def levels(scores: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Distinct scores with positive and negative weight, and what lies below and in all."""
    w = F.lit(1).cast("double") if weight is None else weight.cast("double")
    summed = scores.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("neg"))
    below = running(summed, keys, "score", ["pos", "neg"])
    totals = summed.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return below.join(totals, keys) if keys else below.crossJoin(F.broadcast(totals))


def _area() -> Column:
    n = F.max("all_pos") * F.max("all_neg")
    return F.when(n > 0, F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / n)


def _precision() -> Column:
    tp, fp = F.col("all_pos") - F.col("pos_before"), F.col("all_neg") - F.col("neg_before")
    return F.sum(F.when(F.col("all_pos") > 0, F.col("pos") / F.col("all_pos") * tp / (tp + fp)).otherwise(0.0))


def _rate(target: float) -> Column:
    fpr = (F.col("all_neg") - F.col("neg_before")) / F.col("all_neg")
    tpr = (F.col("all_pos") - F.col("pos_before")) / F.col("all_pos")
    return F.max(F.when(fpr <= target, tpr).otherwise(0.0))


def auc_of(leveled: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half; null where a class is missing."""
    return leveled.groupBy(*keys).agg(_area().alias("auc"))


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    return auc_of(levels(scores, keys), keys)


def pr_auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision over distinct thresholds; 0 without positives, 1 without negatives."""
    return levels(scores, keys).groupBy(*keys).agg(_precision().alias("pr_auc"))


def tpr_at_fpr(scores: DataFrame, keys: list[str], target: float) -> DataFrame:
    """Highest true positive rate among thresholds whose false positive rate is at most ``target`` (0 if none is)."""
    return levels(scores, keys).groupBy(*keys).agg(_rate(target).alias("tpr"))


def ranking_summary(scores: DataFrame, keys: list[str], target: float) -> DataFrame:
    """(keys, auc, pr_auc, tpr): the three ranking measures from one table of levels."""
    return levels(scores, keys).groupBy(*keys).agg(_area().alias("auc"), _precision().alias("pr_auc"), _rate(target).alias("tpr"))


def d_prime(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(mean attack - mean benign) / sqrt of the mean sample variance; null with fewer than two rows of a class."""
    a, b = F.when(F.col("y") == 1, F.col("score")), F.when(F.col("y") == 0, F.col("score"))
    gap = (F.avg(a) - F.avg(b)) / F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2 + 1e-24)
    return scores.groupBy(*keys).agg(F.when((F.count(a) >= 2) & (F.count(b) >= 2), gap).alias("d_prime"))


def threshold_at_fpr(scores: DataFrame, keys: list[str], fpr: float) -> DataFrame:
    """The (1 - fpr) quantile of benign scores, interpolated."""
    return quantile(scores.where("y = 0"), keys, "score", 1 - fpr, "threshold")


def confusion(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fp, fn, tn) of score > threshold."""
    hit = F.col("score") > F.col("threshold")
    y = F.col("y") == 1
    return scores.join(F.broadcast(thresholds), keys).groupBy(*keys).agg(
        F.count_if(hit & y).cast("double").alias("tp"), F.count_if(hit & ~y).cast("double").alias("fp"), F.count_if(~hit & y).cast("double").alias("fn"), F.count_if(~hit & ~y).cast("double").alias("tn")
    )


def macro_f1(confused: DataFrame, keys: list[str]) -> DataFrame:
    def f1(hit: str) -> Column:
        bottom = 2 * F.col(hit) + F.col("fp") + F.col("fn")
        return F.when(bottom > 0, 2 * F.col(hit) / bottom).otherwise(0.0)

    return confused.select(*keys, ((f1("tp") + f1("tn")) / 2).alias("macro_f1"))


def mcc(confused: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    bottom = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return confused.select(*keys, F.when(bottom > 0, (tp * tn - fp * fn) / F.sqrt(bottom)).otherwise(0.0).alias("mcc"))


def mean_ci_t(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and half width of the 95 % t interval over finite values; beyond ten values the normal point 1.96 serves."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    point: Column = F.lit(1.96)
    for df, t in T_975.items():
        point = F.when(F.col("n") == df + 1, t).otherwise(point)
    summed = finite.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("__s"))
    return summed.select(*keys, "n", "mean", F.when(F.col("n") > 1, point * F.col("__s") / F.sqrt("n")).alias("half_width"))


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Rank correlation over pairs without nulls; null below three pairs or without two values on either side.  ``buckets=1`` is for small groups."""
    ranked = midranks(midranks(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "__rx", buckets), keys, y, "__ry", buckets)
    varied = (F.min("__rx") < F.max("__rx")) & (F.min("__ry") < F.max("__ry"))
    moments = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), varied.alias("__varied"), F.covar_pop("__rx", "__ry").alias("__xy"), F.var_pop("__rx").alias("__xx"), F.var_pop("__ry").alias("__yy"))
    return moments.select(*keys, F.when((F.col("__n") >= 3) & F.col("__varied"), F.col("__xy") / F.sqrt(F.col("__xx") * F.col("__yy"))).alias("rho"))


def kendall_tau(rows: DataFrame, keys: list[str], item: str, x: str, y: str) -> DataFrame:
    """Tau-b over pairs of items (a table of detectors, not of rows)."""
    a = rows.select(*keys, F.col(item).alias("__i"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    b = rows.select(*keys, F.col(item).alias("__j"), F.col(x).alias("__x2"), F.col(y).alias("__y2"))
    sx, sy = F.signum(F.col("__x") - F.col("__x2")), F.signum(F.col("__y") - F.col("__y2"))
    pairs = a.join(b, keys).where("__i < __j")
    return pairs.groupBy(*keys).agg((F.sum(sx * sy) / F.sqrt(F.sum(sx * sx) * F.sum(sy * sy))).alias("tau"))


def draws(units: DataFrame, unit: str, reps: int, seed: int) -> DataFrame:
    """(rep, unit, times): bootstrap draws of the units, by md5 of seed, replicate and slot."""
    numbered = running(units.select(unit).distinct().withColumn("__one", F.lit(1)), [], unit, ["__one"]).select(unit, F.col("__one_before").alias("__at"))
    count = numbered.agg(F.count(F.lit(1)).alias("__n"))
    slots = numbered.select(F.col("__at").alias("__slot")).crossJoin(F.broadcast(count)).crossJoin(units.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    drawn = slots.select("rep", md5_draw(F.concat_ws(":", F.lit(str(seed)), "rep", "__slot"), F.col("__n")).alias("__at"))
    return drawn.groupBy("rep", "__at").agg(F.count(F.lit(1)).alias("times")).join(numbered, "__at").select("rep", unit, "times")


def draws_within(units: DataFrame, stratum: str, unit: str, reps: int, seed: int) -> DataFrame:
    """(rep, stratum, unit, times): draws of each stratum's units among themselves."""
    within = Window.partitionBy(stratum)
    numbered = units.select(stratum, unit).distinct().withColumn("__at", F.row_number().over(within.orderBy(unit)) - 1).withColumn("__n", F.count(F.lit(1)).over(within))
    slots = numbered.select(stratum, F.col("__at").alias("__slot"), "__n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = slots.select("rep", stratum, md5_draw(F.concat_ws(":", F.lit(str(seed)), "rep", stratum, "__slot"), F.col("__n")).alias("__at"))
    return drawn.groupBy("rep", stratum, "__at").agg(F.count(F.lit(1)).alias("times")).join(numbered, [stratum, "__at"]).select("rep", stratum, unit, "times")


def stratified_rho(copies: DataFrame, stratum: str, x: str, y: str) -> DataFrame:
    """(rep, rho): the mean of the strata's rank correlations, of replicates in which all strata have one."""
    rho = spearman(copies, ["rep", stratum], x, y, 1)
    strata = copies.select(stratum).distinct().agg(F.count(F.lit(1)).alias("__k"))
    means = rho.groupBy("rep").agg(F.avg("rho").alias("rho"), F.count("rho").alias("__n"))
    return means.crossJoin(F.broadcast(strata)).where("__n = __k").select("rep", "rho")


def percentile_interval(replicates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replicates with a value, and the 2.5 % and 97.5 % points."""
    return replicates.groupBy(*keys).agg(F.count(value).alias("reps"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def group_bootstrap_auc(scores: DataFrame, keys: list[str], group: str, reps: int, seed: int) -> DataFrame:
    """(keys, rep, auc) of resampled whole groups; rows are summed by group and score before any replicate."""
    summed = scores.groupBy(*keys, group, "score", "y").agg(F.count(F.lit(1)).alias("__n"))
    drawn = summed.join(draws(scores, group, reps, seed), group)
    by = [*keys, "rep"]
    return auc_of(levels(drawn, by, F.col("__n") * F.col("times")), by)


def two_way_bootstrap(cells: DataFrame, unit: str, seeds: str, value: str, reps: int, seed: int) -> DataFrame:
    """(rep, mean) of a units x seeds table resampled in both directions."""
    a = draws(cells, unit, reps, seed).withColumnRenamed("times", "__a")
    b = draws(cells, seeds, reps, seed + 1).withColumnRenamed("times", "__b")
    w = F.col("__a") * F.col("__b")
    drawn = cells.join(a, unit).join(b, ["rep", seeds])
    return drawn.groupBy("rep").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"))


def holm(pvalues: DataFrame, p: str, key: str) -> DataFrame:
    """``pvalues`` (a small table) with step-down adjusted p-values."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy(p, key)) - 1
    scaled = pvalues.withColumn("__s", (n - i) * F.col(p)).withColumn("__i", i)
    return scaled.withColumn("adjusted", F.least(F.lit(1.0), F.max("__s").over(Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)))).drop("__s", "__i")


def delong(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: two AUCs on the same rows, z and two-sided p of their difference (fast midrank form)."""
    out = pairs.withColumn("__id", F.monotonically_increasing_id()) if "__id" not in pairs.columns else pairs
    for s in (a, b):
        out = midranks(midranks(out, [], s, f"__all_{s}"), ["y"], s, f"__own_{s}")
    counts = pairs.agg(F.count_if(F.col("y") == 1).alias("__m"), F.count_if(F.col("y") == 0).alias("__n"))
    out = out.crossJoin(F.broadcast(counts))
    other = F.when(F.col("y") == 1, F.col("__n")).otherwise(F.col("__m"))

    def part(s: str) -> Column:
        v = (F.col(f"__all_{s}") - F.col(f"__own_{s}")) / other
        return F.when(F.col("y") == 1, v).otherwise(1 - v)

    v = out.withColumn("__va", part(a)).withColumn("__vb", part(b))
    per = v.groupBy("y").agg(F.avg("__va").alias("auc_a"), F.avg("__vb").alias("auc_b"), F.var_samp("__va").alias("sa"), F.var_samp("__vb").alias("sb"), F.covar_samp("__va", "__vb").alias("sab"), F.count(F.lit(1)).alias("k"))
    whole = per.agg(F.max(F.when(F.col("y") == 1, F.col("auc_a"))).alias("auc_a"), F.max(F.when(F.col("y") == 1, F.col("auc_b"))).alias("auc_b"), F.sum((F.col("sa") + F.col("sb") - 2 * F.col("sab")) / F.col("k")).alias("variance"))
    z = (F.col("auc_a") - F.col("auc_b")) / F.sqrt("variance")
    return whole.select("auc_a", "auc_b", z.alias("z")).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))
