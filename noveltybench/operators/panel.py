"""Sequential and cross-sectional statistics of panels: (entity, t, s) tables.

Series operators are partitioned by entity, peer operators by time; nothing is
partitioned by neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from noveltybench.functions.sampling import md5_unit
from noveltybench.operators.coordination import statistic
from noveltybench.operators.past import SLICE_ROWS, past_ranks
from noveltybench.operators.ranks import normal_cdf, normal_quantile, quantile, running


def by_entity() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("t")


def so_far() -> WindowSpec:
    return by_entity().rowsBetween(Window.unboundedPreceding, 0)


def dense_panel(rows: DataFrame) -> DataFrame:
    """Every entity at every time that occurs, missing cells 0."""
    summed = rows.groupBy("entity", "t").agg(F.sum("s").alias("s"))
    grid = summed.select("entity").distinct().crossJoin(summed.select("t").distinct())
    return grid.join(summed, ["entity", "t"], "left").fillna(0.0, ["s"])


def median_residual(panel: DataFrame, column: str = "s") -> DataFrame:
    """``panel`` with ``residual``: the value less its cross-sectional median."""
    median = quantile(panel, ["t"], column, 0.5, "__m")
    return panel.join(median, "t").withColumn("residual", F.col(column) - F.col("__m")).drop("__m")


def unit(*keys: str) -> Column:
    """The tie-breaking uniform of a cell."""
    return md5_unit(F.concat_ws(":", *keys))


def conformal_p(greater: Column, equal: Column, n: Column, u: Column) -> Column:
    """(greater + U (equal + 1)) / (n + 1)."""
    return (greater + u * (equal + 1)) / (n + 1)


def p_train_ref(panel: DataFrame, w0: int) -> DataFrame:
    """(entity, t, p) of cells from ``w0`` on against all cells before it."""
    both = panel.groupBy("s").agg(F.count_if(F.col("t") < w0).alias("n"))
    ranked = running(both, [], "s", ["n"]).select("s", "n", "n_before")
    total = both.agg(F.sum("n").alias("__n"))
    probe = panel.where(F.col("t") >= w0).join(ranked, "s").crossJoin(F.broadcast(total))
    return probe.select("entity", "t", conformal_p(F.col("__n") - F.col("n_before") - F.col("n"), F.col("n"), F.col("__n"), unit("entity", "t")).alias("p"))


def p_peer_rank(panel: DataFrame) -> DataFrame:
    """(entity, t, p): (peers above + U) / N at each time."""
    w = Window.partitionBy("t")
    above = F.rank().over(w.orderBy(F.col("s").desc())) - 1
    return panel.select("entity", "t", ((above + unit("entity", "t")) / F.count(F.lit(1)).over(w)).alias("p"))


def p_lagged(series: DataFrame, column: str, length: int, gap: int, stride: int) -> DataFrame:
    """(entity, t, p) against the entity's own values at t-gap-length .. t-gap-1, every ``stride`` steps, full references only."""
    past = F.collect_list(column).over(by_entity().rowsBetween(-(gap + length), -(gap + 1)))
    held = series.withColumn("__past", past).where((F.size("__past") == length) & (F.pmod("t", F.lit(stride)) == 0))
    greater, equal = F.size(F.filter("__past", lambda x: x > F.col(column))), F.size(F.filter("__past", lambda x: x == F.col(column)))
    return held.select("entity", "t", conformal_p(greater, equal, F.lit(length), unit("entity", "t")).alias("p"))


def p_full_past(series: DataFrame, column: str, warm: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(entity, t, p): smoothed rank among all values so far, itself included; masked during warm-up.

    Steps are what ``past.past_ranks`` says; a series of any length is shared by tasks.
    """
    ranked = past_ranks(series, column, slice_rows).where(F.col("place") >= warm)
    return ranked.select("entity", "t", ((F.col("above") + unit("entity", "t") * (F.col("same") + 1)) / (F.col("place") + 1)).alias("p"))


def power_e(p: Column, kappa: float, cap: float) -> Column:
    """min(kappa p^(kappa-1), cap)."""
    return F.least(F.lit(kappa) * F.pow(p, F.lit(kappa - 1)), F.lit(cap))


def mixture_e(p: Column) -> Column:
    """(1 - p + p ln p) / (p ln^2 p) with p clipped to [1e-12, 1 - 1e-12]."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return (1 - q + q * F.log(q)) / (q * F.log(q) * F.log(q))


def roc_slope_e(p: Column, delta: float, share: float = 1.0) -> Column:
    """exp(delta z - delta^2 / 2) with z the normal quantile of 1 - p; ``share`` below 1 hedges it with the constant 1."""
    z = normal_quantile(1 - F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12)))
    return F.lit(share) * F.exp(F.lit(delta) * z - F.lit(delta * delta / 2)) + F.lit(1 - share)


def ecusum_no_reset(evalues: DataFrame, alarm: float) -> DataFrame:
    """(entity, t, log_m, first_alarm): M = max(M, 1) e, as prefix sums of ln e less their running minimum."""
    total = evalues.withColumn("__s", F.sum(F.log("e")).over(so_far()))
    lowest = F.least(F.lit(0.0), F.coalesce(F.min("__s").over(by_entity().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    walked = total.withColumn("log_m", F.col("__s") - lowest)
    first = F.min(F.when(F.col("log_m") >= F.log(F.lit(alarm)), F.col("t"))).over(Window.partitionBy("entity"))
    return walked.select("entity", "t", "log_m", first.alias("first_alarm"))


def ecusum_reset(evalues: DataFrame, alarm: float) -> DataFrame:
    """(entity, alarms): times at which M = max(M, 1) e reaches the alarm level, M restarting at 1."""
    steps = evalues.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("t", "e"))).alias("steps"))
    start = F.struct(F.lit(1.0).alias("m"), F.array().cast("array<int>").alias("alarms"))

    def step(state: Column, x: Column) -> Column:
        m = F.greatest(state["m"], F.lit(1.0)) * x["e"]
        hit = m >= alarm
        return F.struct(F.when(hit, 1.0).otherwise(m).alias("m"), F.when(hit, F.concat(state["alarms"], F.array(x["t"].cast("int")))).otherwise(state["alarms"]).alias("alarms"))

    return steps.select("entity", F.aggregate("steps", start, step, lambda s: s["alarms"]).alias("alarms"))


def alarm_rate(alarms: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row: alarms for each 1000 evaluated steps."""
    n = evaluated.agg(F.count(F.lit(1)).alias("steps"))
    return alarms.agg(F.sum(F.size("alarms")).alias("alarms")).crossJoin(F.broadcast(n)).withColumn("per_1000", 1000 * F.col("alarms") / F.col("steps"))


def uniformity_gap(p: DataFrame, keys: list[str]) -> DataFrame:
    """sup |i/n - p_(i)| within the keys."""
    levels = p.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"))
    at = running(levels, keys, "p", ["n"])
    total = levels.groupBy(*keys).agg(F.sum("n").alias("__n"))
    joined = at.join(total, keys) if keys else at.crossJoin(F.broadcast(total))
    upper = F.abs((F.col("n_before") + F.col("n")) / F.col("__n") - F.col("p"))
    lower = F.abs((F.col("n_before") + 1) / F.col("__n") - F.col("p"))
    return joined.groupBy(*keys).agg(F.max(F.greatest(upper, lower)).alias("gap"))


def exceedances(panel: DataFrame, column: str, q: float, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """``panel`` with b: 1 where the value exceeds the entity's own (1 - q) quantile, or that of all the ``keys``."""
    cut = quantile(panel, list(keys), column, 1 - q, "__cut", 1)
    return panel.join(cut, list(keys)).withColumn("b", (F.col(column) > F.col("__cut")).cast("int")).drop("__cut")


def coordination_naive_test(exceeded: DataFrame) -> DataFrame:
    """One row: the statistic, its expectation under independent entities and the normal z."""
    rates = exceeded.groupBy("entity").agg(F.avg("b").alias("r"))
    pairs = rates.agg(((F.pow(F.sum("r"), F.lit(2)) - F.sum(F.col("r") * F.col("r"))) / 2).alias("__r"), ((F.pow(F.sum(F.col("r") * F.col("r")), F.lit(2)) - F.sum(F.pow("r", F.lit(4)))) / 2).alias("__r2"))
    n = exceeded.select("t").distinct().agg(F.count(F.lit(1)).alias("__T"))
    out = statistic(exceeded).crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(n))
    expected, variance = F.col("__T") * F.col("__r"), F.col("__T") * (F.col("__r") - F.col("__r2"))
    return out.select("stat", expected.alias("expected"), ((F.col("stat") - expected) / F.sqrt(variance)).alias("z"))


def naive_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", 1 - normal_cdf(F.col("z")))


def evalue_product(evalues: DataFrame) -> DataFrame:
    return evalues.groupBy("entity").agg(F.exp(F.sum(F.log("e"))).alias("product"))


def ebh_reject(evalues: DataFrame, value: str, alpha: float) -> DataFrame:
    """Entities rejected by e-BH: E among the k largest, k the largest with E_(k) >= N / (alpha k)."""
    levels = evalues.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = levels.agg(F.sum("n").alias("__N"))
    ranked = running(levels, [], "v", ["n"]).crossJoin(F.broadcast(total)).withColumn("k", F.col("__N") - F.col("n_before"))
    cut = ranked.where(F.col("v") >= F.col("__N") / (F.lit(alpha) * F.col("k"))).agg(F.min("v").alias("__cut"))
    return evalues.crossJoin(F.broadcast(cut)).where(F.col(value) >= F.col("__cut")).drop("__cut")


def window_sums(series: DataFrame, column: str, scales: list[int]) -> DataFrame:
    """(entity, scale, t, total): sums of the last ``scale`` values at every scale/4 steps."""
    prefix = series.withColumn("__c", F.sum(column).over(so_far())).withColumn("__i", F.row_number().over(by_entity()))
    parts = []
    for s in scales:
        total = F.col("__c") - F.coalesce(F.lag("__c", s).over(by_entity()), F.lit(0.0))
        parts.append(prefix.withColumn("total", total).where((F.col("__i") >= s) & ((F.col("__i") - s) % max(s // 4, 1) == 0)).select("entity", F.lit(s).alias("scale"), "t", "total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def peer_studentized(sums: DataFrame) -> DataFrame:
    """(entity, score): the largest studentised distance of an entity's window sum from its peers'."""
    w = Window.partitionBy("scale", "t")
    n = F.count(F.lit(1)).over(w) - 1
    mean = (F.sum("total").over(w) - F.col("total")) / n
    square = F.sum(F.col("total") * F.col("total")).over(w) - F.col("total") * F.col("total")
    sd = F.sqrt(F.greatest((square - n * mean * mean) / (n - 1), F.lit(0.0)))
    scored = sums.withColumn("z", F.when(sd > 0, (F.col("total") - mean) / (sd * F.sqrt(1 + 1 / n))))
    return scored.groupBy("entity").agg(F.max("z").alias("score"))


def variance_time_hurst(series: DataFrame, column: str, blocks: list[int]) -> DataFrame:
    """(entity, hurst): half the log-log slope of block-sum variance against block size, clipped to [0.5, 0.99]."""
    sizes = F.explode(F.array(*[F.lit(m) for m in blocks])).alias("m")
    spread = series.select("entity", "t", column, sizes)
    sums = spread.groupBy("entity", "m", F.floor(F.col("t") / F.col("m")).alias("b")).agg(F.sum(column).alias("s"))
    variance = sums.groupBy("entity", "m").agg(F.var_samp("s").alias("v")).where("v > 0")
    slope = variance.groupBy("entity").agg(F.regr_slope(F.log("v"), F.log("m")).alias("slope"))
    return slope.select("entity", F.least(F.greatest(F.col("slope") / 2, F.lit(0.5)), F.lit(0.99)).alias("hurst"))


def own_history_sums(series: DataFrame, column: str, scales: list[int], blocks: list[int]) -> DataFrame:
    """(entity, scale, t, total, spread): window sums of the centred series and sqrt(V1) * scale ** H."""
    stats = series.groupBy("entity").agg(F.avg(column).alias("__m"), F.var_samp(column).alias("__v"))
    centred = series.join(stats, "entity").withColumn("__x", F.col(column) - F.col("__m"))
    sums = window_sums(centred.select("entity", "t", F.col("__x").alias("x")), "x", scales)
    scaled = sums.join(stats, "entity").join(variance_time_hurst(series, column, blocks), "entity").where("__v > 0")
    return scaled.select("entity", "scale", "t", "total", (F.sqrt("__v") * F.pow(F.col("scale"), F.col("hurst"))).alias("spread"))


def own_history_scan(series: DataFrame, column: str, scales: list[int], blocks: list[int]) -> DataFrame:
    """(entity, score): the largest window sum of the centred series over its spread."""
    return own_history_sums(series, column, scales, blocks).groupBy("entity").agg(F.max(F.col("total") / F.col("spread")).alias("score"))


def cusum_path(series: DataFrame, z: str, k: float, h: float) -> DataFrame:
    """(entity, t, path, first_alarm): S = max(0, S + z - k), as prefix sums less their running minimum."""
    total = series.withColumn("__s", F.sum(F.col(z) - k).over(so_far()))
    path = total.withColumn("path", F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(so_far())))
    first = F.min(F.when(F.col("path") >= h, F.col("t"))).over(Window.partitionBy("entity"))
    return path.select("entity", "t", "path", first.alias("first_alarm"))


def affine_scan(series: DataFrame, factor: float, added: str, steps: int, start: DataFrame | None = None, length: int = 64) -> DataFrame:
    """(entity, t, before, after): v = ``factor`` v + ``added`` along t = 0, 1 .. ``steps`` - 1, without gaps; v before and after each step.

    ``start`` (entity, start) is v before the first step, 0 without it.  A step is an affine map, and so is a slice of
    steps: slices of ``length`` steps are summed on their own from 0, the maps of whole slices are a shorter series of
    the same kind, and what a slice begins with is added to its steps.  One long series is so many keys.
    """
    if not 0 < factor <= 1:
        raise ValueError("the factor must be in (0, 1]")
    while length > 2 and factor**length < 1e-150:  # powers of the factor must be doubles
        length //= 2
    rows = series.select("entity", F.col("t").cast("long").alias("t"), F.floor(F.col("t") / length).alias("__s"), F.pmod(F.col("t"), F.lit(length)).alias("__j"), F.col(added).cast("double").alias("__a"))
    inside = Window.partitionBy("entity", "__s").orderBy("__j")
    power = F.pow(F.lit(factor), F.col("__j"))
    local = rows.withColumn("__local", power * F.sum(F.col("__a") / power).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("__earlier", F.coalesce(F.lag("__local").over(inside), F.lit(0.0)))
    if steps <= length:
        begun = local.join(start.select("entity", F.col("start").cast("double").alias("__begin")), "entity", "left") if start is not None else local.withColumn("__begin", F.lit(0.0))
    else:
        moved = local.groupBy("entity", F.col("__s").alias("t")).agg(F.max_by("__local", "__j").alias("__moved"))
        slices = affine_scan(moved, max(factor**length, 1e-300), "__moved", -(-steps // length), start)
        begun = local.join(slices.select("entity", F.col("t").alias("__s"), F.col("before").alias("__begin")), ["entity", "__s"], "left")
    begin = F.coalesce("__begin", F.lit(0.0))
    return begun.select("entity", "t", (F.col("__earlier") + power * begin).alias("before"), (F.col("__local") + power * F.lit(factor) * begin).alias("after"))


def ewma_last(series: DataFrame, column: str, weight: float, steps: int) -> DataFrame:
    """(entity, last): exponentially weighted mean after the last step of times 0 .. ``steps`` - 1, started at 0."""
    moved = affine_scan(series.withColumn("__x", F.lit(weight) * F.col(column)), 1 - weight, "__x", steps)
    return moved.groupBy("entity").agg(F.max_by("after", "t").alias("last"))


def ewma_path(series: DataFrame, column: str, reference: int, steps: int, weight: float = 0.05, base_weight: float = 0.005) -> DataFrame:
    """(entity, t, path) from t = ``reference`` on: the EWMA of the standardised residual, in units of its own deviation.

    Mean and deviation (divisor n) come from the times before ``reference``; the mean then follows the series at
    ``base_weight``, so slow changes are absorbed.  A reference without spread has a null path.
    """
    fitted = series.where(F.col("t") < reference).groupBy("entity").agg(F.avg(column).alias("start"), F.stddev_pop(column).alias("sd"))
    watched = series.where(F.col("t") >= reference).select("entity", (F.col("t") - reference).cast("long").alias("t"), F.col(column).cast("double").alias("x"))
    base = affine_scan(watched.withColumn("__x", F.lit(base_weight) * F.col("x")), 1 - base_weight, "__x", steps - reference, fitted)
    residual = watched.join(base.select("entity", "t", "before"), ["entity", "t"]).join(fitted, "entity").select("entity", "t", F.when(F.col("sd") > 0, F.lit(weight) * (F.col("x") - F.col("before")) / F.col("sd")).otherwise(0.0).alias("__r"))
    path = affine_scan(residual, 1 - weight, "__r", steps - reference).join(fitted.select("entity", "sd"), "entity")
    return path.select("entity", (F.col("t") + reference).cast("int").alias("t"), F.when(F.col("sd") > 0, F.col("after") / F.lit((weight / (2 - weight)) ** 0.5)).alias("path"))


def critical_amplitude(statistics: DataFrame, onset: int, length: int, threshold: float) -> DataFrame:
    """(entity, step, ramp): the least amplitude of an attack of either shape that some window's statistic would show.

    ``statistics`` has entity, scale, t (last step of the window), total and spread.  A step adds its amplitude at each
    of the attack's steps, a ramp 1/length of it more at each; windows without a step of the attack don't count.
    """
    first, last = F.greatest(F.col("t") + 1 - F.col("scale"), F.lit(onset)), F.least(F.col("t") + 1, F.lit(onset + length))
    met = statistics.withColumn("__n", last - first).where("__n > 0")
    rising = (first - onset + 1 + last - onset) * F.col("__n") / 2 / length

    def least(weight: Column) -> Column:
        return F.min(F.greatest((F.lit(threshold) * F.col("spread") - F.col("total")) / weight, F.lit(0.0)))

    return met.groupBy("entity").agg(least(F.col("__n")).alias("step"), least(rising).alias("ramp"))


def threshold_matched(maxima: DataFrame, alpha: float, nominal: float) -> DataFrame:
    """One row: the (1 - alpha) quantile of per-series maxima and the share above a nominal threshold."""
    return maxima.agg(F.percentile("score", 1 - alpha).alias("threshold"), F.avg((F.col("score") > nominal).cast("int")).alias("above_nominal"))


def detection_delay(alarms: DataFrame, attacks: DataFrame) -> DataFrame:
    """(entity, t0, delay): steps from an attack's start to the first alarm inside [t0, t0 + duration)."""
    times = alarms.select("entity", F.explode("alarms").alias("at"))
    hit = attacks.join(times, "entity", "left").withColumn("__in", (F.col("at") >= F.col("t0")) & (F.col("at") < F.col("t0") + F.col("duration")))
    return hit.groupBy("entity", "t0").agg((F.min(F.when(F.col("__in"), F.col("at"))) - F.col("t0")).alias("delay"))
