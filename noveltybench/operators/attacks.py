"""Attacks, as intervals of an entity's time, against its evaluated steps and alarms.

An attack table has entity, t0, duration and a ``setting`` by which attacks are summed up; a step table has entity, t,
the p-value, the e-value and whether the step alarmed.  The interval join is an equi-join on buckets of time: an
attack is copied to the buckets that it covers, so a busy entity is many keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.operators.ranks import quantile

BUCKET = 64


def steps_within(steps: DataFrame, attacks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each step once for each attack on its entity whose [t0, t0 + duration) holds it; an attack of no duration holds none."""
    last = F.floor((F.col("t0") + F.col("duration") - 1) / bucket)
    spread = attacks.where("duration > 0").withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("t0") / bucket), last)))
    at = steps.withColumn("__bucket", F.floor(F.col("t") / bucket))
    return at.join(spread, ["entity", "__bucket"]).where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t0") + F.col("duration"))).drop("__bucket")


def each_attack(steps: DataFrame, attacks: DataFrame, stride: int = 1, level: float = 0.01, bucket: int = BUCKET) -> DataFrame:
    """(setting, entity, t0, duration, evaluated, delay, log_e, share): one row an attack.

    ``delay`` is the time to the first alarm in evaluated windows (every ``stride`` steps), null without one; ``log_e``
    the sum of ln e over its evaluated steps; ``share`` how many of them have p <= ``level``, null without any.
    """
    keys = ["setting", "entity", "t0", "duration"]
    named = attacks.select(*keys).distinct()
    met = steps_within(steps, named, bucket).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.min(F.when(F.col("alarm"), F.col("t"))).alias("__first"),
        F.sum(F.log("e")).alias("log_e"),
        F.avg((F.col("p") <= level).cast("double")).alias("share"),
    )
    joined = named.join(met, keys, "left")
    delay = (F.col("__first") - F.col("t0")) / F.lit(stride)
    return joined.select(*keys, F.coalesce("evaluated", F.lit(0)).alias("evaluated"), delay.alias("delay"), F.coalesce("log_e", F.lit(0.0)).alias("log_e"), "share")


def detection_summary(found: DataFrame, alarm: float) -> DataFrame:
    """One row a setting of `each_attack`: (setting, attacks, windows, detected, median_delay, mean_log_e, predicted_delay, tpr).

    ``windows`` are the evaluated steps inside attacks, ``detected`` the share of attacks with an alarm, the median over
    those, ``predicted_delay`` ln(alarm) / mean ln e (null where that is not positive), ``tpr`` the mean of the attacks' shares.
    """
    mean = F.when(F.sum("evaluated") > 0, F.sum("log_e") / F.sum("evaluated"))
    sums = found.groupBy("setting").agg(
        F.count(F.lit(1)).alias("attacks"), F.sum("evaluated").alias("windows"), F.avg(F.col("delay").isNotNull().cast("double")).alias("detected"), mean.alias("mean_log_e"), F.avg("share").alias("tpr")
    )
    median = quantile(found, ["setting"], "delay", 0.5, "median_delay")
    predicted = F.when(F.col("mean_log_e") > 0, F.log(F.lit(alarm)) / F.col("mean_log_e"))
    return sums.join(median, "setting", "left").select("setting", "attacks", "windows", "detected", "median_delay", "mean_log_e", predicted.alias("predicted_delay"), "tpr")
