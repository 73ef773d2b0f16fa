"""Spectral, recurrence and score functions of stored vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.operators.ranks import running


def wasserstein_1d(samples: DataFrame) -> DataFrame:
    """(feature, distance): the integral of |F - G| between the two samples of each feature (columns feature, v, first)."""
    at = samples.groupBy("feature", "v").agg(F.count_if("first").cast("double").alias("a"), F.count_if(~F.col("first")).cast("double").alias("b"))
    cum = running(at, ["feature"], "v", ["a", "b"])
    totals = at.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.lead("v").over(Window.partitionBy("feature").orderBy("v")) - F.col("v")
    step = F.abs((F.col("a_before") + F.col("a")) / F.col("na") - (F.col("b_before") + F.col("b")) / F.col("nb")) * F.col("gap")
    return cum.withColumn("gap", gap).join(totals, "feature").groupBy("feature").agg(F.sum(step).alias("distance"))


def power(x: Column, n: int) -> Column:
    """One-sided power of an array of ``n`` numbers: mean square split over n/2 + 1 frequencies (their sum is the mean square)."""

    def at(w: int) -> Column:
        re, im = ([math.cos(2 * math.pi * w * t / n) for t in range(n)], [math.sin(2 * math.pi * w * t / n) for t in range(n)])
        dot = [F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in table]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for table in (re, im)]
        weight = 1.0 if w in (0, n // 2) else 2.0
        return (dot[0] * dot[0] + dot[1] * dot[1]) * F.lit(weight / (n * n))

    return F.array(*[at(w) for w in range(n // 2 + 1)])


def linear_recurrence(u: Column, alpha: float, beta: float, gamma: float) -> Column:
    """Outputs y = h - E of h += alpha (u - h) + beta (E - h), E += gamma (h - E), from zero."""
    start = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("ys"))

    def step(s: Column, x: Column) -> Column:
        h = s["h"] + alpha * (x - s["h"]) + beta * (s["e"] - s["h"])
        e = s["e"] + gamma * (h - s["e"])
        return F.struct(h.alias("h"), e.alias("e"), F.concat(s["ys"], F.array(h - e)).alias("ys"))

    return F.aggregate(u, start, step, lambda s: s["ys"])


def softmax_terms(logits: Column) -> Column:
    """exp(logit - max)."""
    return F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def msp(logits: Column) -> Column:
    return 1 - 1 / total(softmax_terms(logits))


def p_attack(logits: Column) -> Column:
    return F.element_at(softmax_terms(logits), 2) / total(softmax_terms(logits))


def energy(logits: Column) -> Column:
    return -(F.array_max(logits) + F.log(total(softmax_terms(logits))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def step_norms(x: Column, n: int, width: int) -> Column:
    """Norm of each step of a vector of n / width places."""
    places = n // width
    return F.transform(F.sequence(F.lit(1), F.lit(places - 1)), lambda p: F.sqrt(total(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda c: F.pow(F.element_at(x, (p * width + c).cast("int")) - F.element_at(x, ((p - 1) * width + c).cast("int")), F.lit(2))))))


def mean_of(x: Column) -> Column:
    return total(x) / F.size(x)


def var_pop_of(x: Column) -> Column:
    m = mean_of(x)
    return total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x)
