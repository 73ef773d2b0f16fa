"""Running sums and midranks over very large groups.

A window sorts all rows of its keys in one task.  Here rows are first summed to
distinct values; the largest group is counted, and where it has more values than a
task should sort, values are dealt to as many buckets as that needs by approximate
quantiles, each bucket is summed on its own, and bucket totals (a few rows) carry over.
A quantile of a large group needs no running sums: an approximate bracket leaves few
values around it, and what lies outside is only counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Distinct values of a group that one task sorts.
PER_BUCKET = 100_000
#: Least accuracy of the bracket around a quantile: its ends are off by a share 1 / ACCURACY of the rows.
ACCURACY = 10_000


def fitting(levels: DataFrame, keys: list[str]) -> int:
    """Buckets that the largest group needs; counts the groups, so it runs a job."""
    if not keys:
        return max(1, -(-levels.count() // PER_BUCKET))
    largest = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(largest or 0) // PER_BUCKET))


def _below(cuts: str, value: Column, n: int) -> Column:
    """How many of the ``n`` ascending cuts are smaller than the value, by halving; 0 without cuts."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col(cuts), at + step - 1) < value, at + step).otherwise(at))


def running(levels: DataFrame, keys: list[str], value: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """``levels`` (distinct values within the keys) with ``<sum>_before``: the sums over smaller values of the same keys.

    Answers don't depend on the number of buckets; without it, it follows from the size of the largest group.
    """
    buckets, least = (fitting(levels, keys), PER_BUCKET) if buckets is None else (buckets, 0)
    if buckets <= 1:  # small groups: one window over each is enough
        inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return levels.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"{s}_before") for s in sums])
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = levels.groupBy(*keys).agg(F.percentile_approx(value, points, max(1_000, 20 * buckets)).alias("__cuts"), F.count(F.lit(1)).alias("__rows"))
    # Only groups that need buckets have cuts: a row for every PER_BUCKET levels at most, so all tasks hold them.
    cuts = F.broadcast(cuts.where(F.col("__rows") > least).drop("__rows"))
    dealt = levels.join(cuts, keys, "left") if keys else levels.crossJoin(cuts)
    dealt = dealt.withColumn("__bucket", _below("__cuts", F.col(value), buckets - 1)).drop("__cuts")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__bucket").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__{s}").over(across), F.lit(0)).alias(f"__{s}_carried") for s in sums])
    summed = dealt.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__{s}_inside") for s in sums]).join(carried, [*keys, "__bucket"])
    kept = [c for c in levels.columns]
    return summed.select(*kept, *[(F.col(f"__{s}_inside") + F.col(f"__{s}_carried")).alias(f"{s}_before") for s in sums])


def midranks(rows: DataFrame, keys: list[str], value: str, out: str = "midrank", buckets: int | None = None) -> DataFrame:
    """``rows`` with the average rank (from 1) of ``value`` within the keys."""
    levels = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(levels, keys, value, ["__n"], buckets).select(*keys, value, (F.col("__n_before") + (F.col("__n") + 1) / 2).alias(out))
    return rows.join(ranked, [*keys, value])


def _ends(below: DataFrame, keys: list[str], q: float, out: str, *more: Column) -> DataFrame:
    """(keys, out, more): the quantile from values ``__v`` with counts ``__n``, ``__n_before`` and ``__all``."""
    at = F.lit(q) * (F.col("__all") - 1)
    low, high = F.max(F.when(_holds(F.floor(at)), F.col("__v"))), F.max(F.when(_holds(F.ceil(at)), F.col("__v")))
    ends = below.groupBy(*keys).agg(low.alias("__low"), high.alias("__high"), F.max(at - F.floor(at)).alias("__share"), *more)
    names = [c for c in ends.columns if c not in (*keys, "__low", "__high", "__share")]
    return ends.select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__share")).alias(out), *names)


def _holds(place: Column) -> Column:
    return (F.col("__n_before") <= place) & (place < F.col("__n_before") + F.col("__n"))


def _by_levels(cells: DataFrame, keys: list[str], q: float, out: str, buckets: int | None = None) -> DataFrame:
    """The quantile by running sums over all distinct values."""
    levels = cells.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    total = levels.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    below = running(levels, keys, "__v", ["__n"], buckets)
    return _ends(below.join(total, keys) if keys else below.crossJoin(F.broadcast(total)), keys, q, out)


def brackets(cells: DataFrame, keys: list[str], q: float, largest: int) -> DataFrame:
    """(keys, __from, __to): values a little below and above the quantile, from sketches of bounded size."""
    accuracy = max(ACCURACY, largest * 5 // PER_BUCKET)
    points = F.array(F.lit(max(q - 2 / accuracy, 0.0)), F.lit(min(q + 2 / accuracy, 1.0)))
    ends = cells.groupBy(*keys).agg(F.percentile_approx("__v", points, accuracy).alias("__e"))
    return ends.select(*keys, F.col("__e")[0].alias("__from"), F.col("__e")[1].alias("__to"))


def _narrowed(cells: DataFrame, keys: list[str], q: float, out: str, bounds: DataFrame) -> DataFrame:
    """(keys, out, __missed): only values inside the bounds are told apart; missed where the quantile lies outside."""
    near = cells.join(F.broadcast(bounds), keys) if keys else cells.crossJoin(F.broadcast(bounds))
    near = near.withColumn("__zone", F.when(F.col("__v") < F.col("__from"), 0).when(F.col("__v") > F.col("__to"), 2).otherwise(1))
    levels = near.groupBy(*keys, "__zone", F.when(F.col("__zone") == 1, F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy(*keys).orderBy("__zone", "__v").rowsBetween(Window.unboundedPreceding, -1)
    below = levels.select("*", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__n_before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"))
    at = F.lit(q) * (F.col("__all") - 1)
    return _ends(below, keys, q, out, F.max((F.col("__zone") != 1) & (_holds(F.floor(at)) | _holds(F.ceil(at)))).alias("__missed"))


def quantile(rows: DataFrame, keys: list[str], value: str, q: float, out: str, buckets: int | None = None) -> DataFrame:
    """(keys, out): the exact quantile of the values within the keys, interpolated; nulls don't count.

    Groups of up to PER_BUCKET rows are counted by value.  A larger one is narrowed to the values near its quantile, at
    once: those answers are one row for every PER_BUCKET rows at most.  Should its bracket miss, all its values are ranked.
    """
    cells = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if buckets is not None:
        return _by_levels(cells, keys, q, out, buckets)
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    whole = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    many, largest, small = sizes.where(whole).agg(F.count_if(F.col("__rows") > PER_BUCKET), F.max("__rows"), F.count_if(F.col("__rows") <= PER_BUCKET)).first()
    if not many:
        return _by_levels(cells, keys, q, out, 1)
    spark = rows.sparkSession

    def local(found: list[Row], like: DataFrame) -> DataFrame:
        return spark.createDataFrame(found, like.schema)

    def only(names: DataFrame, how: str) -> DataFrame:
        return cells.join(F.broadcast(names), keys, how) if keys else cells

    names = sizes.where(whole & (F.col("__rows") > PER_BUCKET)).select(*keys)
    large = local(names.collect(), names) if small else None
    bounds = brackets(cells if large is None else only(large, "left_semi"), keys, q, largest)
    answers = _narrowed(cells, keys, q, out, local(bounds.collect(), bounds))
    found = answers.collect()
    parts = [local([r for r in found if not r["__missed"]], answers).drop("__missed")]
    missed = [r for r in found if r["__missed"]]
    if missed:
        parts.append(_by_levels(only(local(missed, answers).select(*keys), "left_semi"), keys, q, out))
    if small:
        parts.append(_by_levels(only(large, "left_anti"), keys, q, out, 1))
    return reduce(DataFrame.unionByName, parts)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by the complementary error function's rational form (error below 1.2e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * z)
    # The published Chebyshev coefficients of erfc.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly: Column = F.lit(c[-1])
    for a in reversed(c[:-1]):
        poly = F.lit(a) + t * poly
    erfc = t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1 - erfc / 2).otherwise(erfc / 2)


#: The published coefficients of the rational approximation of the normal quantile (relative error below 1.2e-9).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_LOW = 0.02425


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1)."""

    def horner(coefficients: tuple[float, ...], x: Column) -> Column:
        out: Column = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    def tail(q: Column) -> Column:
        x = F.sqrt(-2 * F.log(q))
        return horner(QUANTILE_C, x) / (horner(QUANTILE_D, x) * x + 1)

    x = p - 0.5
    middle = horner(QUANTILE_A, x * x) * x / (horner(QUANTILE_B, x * x) * x * x + 1)
    return F.when(p < QUANTILE_LOW, tail(p)).when(p > 1 - QUANTILE_LOW, -tail(1 - p)).otherwise(middle)
