"""Entities that exceed together: the statistic with a lag tolerance, and its null distributions.

An *exceedance* table has entity, t (0 .. T - 1, T one more than the greatest time) and b (1 where the entity
exceeds).  The statistic counts pairs of hits of two entities at most ``lag`` steps apart, the time line closed to a
circle.  Pairs are never formed: all pairs of hits near each other come from counts by time, those within one entity
from counts by entity and time, and half their difference is the statistic.  Times are cut into slices that overlap
by the lag, so neither a long series nor a hot time is one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a slice of time (more where the lag needs it), and cells of counts a task holds before it sends them on.
SLICE, CELLS = 4_096, 1 << 22


def span(exceeded: DataFrame) -> DataFrame:
    """One row, __T: the number of time steps."""
    return exceeded.agg((F.max("t") + 1).alias("__T"))


def binned(exceeded: DataFrame, size: int) -> DataFrame:
    """Exceedances of bins of ``size`` steps: a bin exceeds if any of its steps does; a last incomplete bin counts."""
    return exceeded.groupBy("entity", F.floor(F.col("t") / size).cast("int").alias("t")).agg(F.max("b").alias("b"))


def near(levels: DataFrame, keys: list[str], value: str, lag: int) -> DataFrame:
    """``levels`` (distinct times within the keys, with __T) with ``near``: the sum of ``value`` at most ``lag`` steps away on the circle.

    Rows close to a slice's edge, or to the ends of the time line, are copied to the slices that see them.
    """
    width = max(SLICE, 4 * lag + 4)
    if lag == 0:
        return levels.withColumn("near", F.col(value))
    checked = F.when(F.col("__T") <= lag, F.raise_error(F.lit("the lag reaches round the whole time line")).cast("int")).otherwise(F.col("t"))
    places = F.array_compact(F.array(checked, F.when(F.col("t") < lag, F.col("t") + F.col("__T")), F.when(F.col("t") >= F.col("__T") - lag, F.col("t") - F.col("__T"))))
    at = levels.withColumn("__p", F.explode(places))
    seen = F.array_distinct(F.array(*[F.floor((F.col("__p") + d) / width) for d in (-lag, 0, lag)]))
    copied = at.withColumn("__slice", F.explode(seen))
    w = Window.partitionBy(*keys, "__slice").orderBy("__p").rangeBetween(-lag, lag)
    home = (F.col("__p") == F.col("t")) & (F.col("__slice") == F.floor(F.col("t") / width))
    return copied.withColumn("near", F.sum(value).over(w)).where(home).drop("__p", "__slice")


def _halved(counts: DataFrame, own: DataFrame, by: list[str], lag: int) -> DataFrame:
    """(by, stat) from hits by time (k, __T) and the ordered pairs within entities (one row, own)."""
    ordered = near(counts, by, "k", lag).groupBy(*by).agg(F.sum(F.col("k") * F.col("near")).alias("__all"))
    return ordered.crossJoin(F.broadcast(own)).select(*by, ((F.coalesce("__all", F.lit(0)) - F.coalesce("own", F.lit(0))) / 2).alias("stat"))


def _own_pairs(hits: DataFrame, lag: int) -> DataFrame:
    """One row, own: ordered pairs of hits near each other within one entity, a hit with itself included.

    Shifting an entity round the circle leaves them as they are.
    """
    return near(hits, ["entity"], "b", lag).agg(F.sum(F.col("b") * F.col("near")).alias("own"))


def statistic(exceeded: DataFrame, lag: int = 0) -> DataFrame:
    """One row, stat: pairs of hits of two entities at most ``lag`` steps apart (each time difference counts)."""
    hits = exceeded.where("b = 1").select("entity", "t", "b").crossJoin(F.broadcast(span(exceeded)))
    counts = hits.groupBy("t", "__T").agg(F.sum("b").alias("k"))
    return _halved(counts, _own_pairs(hits, lag), [], lag)


def shift(seed: int, perm: int, entity: object, steps: int) -> int:
    """0 .. steps - 1 from the first 32 bits of an md5, as `md5_draw` has it."""
    return int(hashlib.md5(f"{seed}:{perm}:{entity}".encode()).hexdigest()[:8], 16) % steps


def shifted_counts(exceeded: DataFrame, perms: int, seed: int, period: int | None = None) -> DataFrame:
    """(perm, t, k): hits by time after each entity is shifted round the circle; ``period`` allows whole periods only.

    Hits travel once, as lists of an entity's times in one slice; a task adds up all its shifted hits, so what is
    shuffled is permutations x times for each task and not permutations x hits.
    """
    hits = exceeded.where("b = 1").groupBy("entity", F.floor(F.col("t") / SLICE).alias("slice")).agg(F.collect_list("t").alias("times"))
    rows = hits.crossJoin(F.broadcast(span(exceeded))).select(F.col("entity").cast("string").alias("entity"), F.col("times").cast("array<long>").alias("times"), F.col("__T").cast("long").alias("steps"))
    numbers = np.arange(perms, dtype=np.int64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, waiting, size = 0, [], 0

        def counted() -> pa.RecordBatch:
            cells, k = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((cells // steps).astype(np.int32)), pa.array((cells % steps).astype(np.int32)), pa.array(k.astype(np.int64)), pa.array(np.full(len(k), steps))], names=["perm", "t", "k", "__T"])

        for batch in batches:
            for entity, times, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = steps // period if period else steps
                if count < 1:
                    raise ValueError("the period is longer than the time line")
                moves = np.array([[shift(seed, p, entity, count) * (period or 1)] for p in range(perms)], np.int64)
                part = np.array(times, np.int64)
                for at in range(0, len(part), max(CELLS // max(perms, 1), 1)):
                    some = part[at : at + max(CELLS // max(perms, 1), 1)]
                    waiting.append((numbers * steps + (some + moves) % steps).ravel())
                    size += waiting[-1].size
                    if size >= CELLS:
                        yield counted()
                        waiting, size = [], 0
        if size:
            yield counted()

    return rows.mapInArrow(run, "perm int, t int, k long, __T long").groupBy("perm", "t", "__T").agg(F.sum("k").alias("k"))


def shift_test(exceeded: DataFrame, perms: int, seed: int, lag: int = 0, period: int | None = None) -> DataFrame:
    """One row, stat and p: the share of circular shifts, drawn for each entity, whose statistic is at least as great.

    With ``period``, shifts are whole periods, so what an entity repeats every period stays in phase.
    """
    hits = exceeded.where("b = 1").select("entity", "t", "b").crossJoin(F.broadcast(span(exceeded)))
    null = _halved(shifted_counts(exceeded, perms, seed, period), _own_pairs(hits, lag), ["perm"], lag).withColumnRenamed("stat", "__s")
    observed = statistic(exceeded, lag)
    reached = observed.join(F.broadcast(null), F.col("__s") >= F.col("stat"), "left")  # perms rows at most
    # Without hits there are no shifted counts either; every statistic is 0 then, and so is each one that ties with 0.
    share = F.when(F.col("stat") == 0, 1.0).otherwise((F.count("__s") + 1) / F.lit(perms + 1))
    return reached.groupBy("stat").agg(share.alias("p"))


def historical_test(exceeded: DataFrame, length: int, lag: int = 0) -> DataFrame:
    """One row, stat and p: the last complete period of ``length`` steps against all complete periods before it.

    Exceedances are taken as given, so thresholds within each period are the caller's; times of a period are closed to a
    circle of its own.
    """
    period = F.floor(F.col("t") / length)
    whole = exceeded.crossJoin(F.broadcast(span(exceeded))).where((period + 1) * length <= F.col("__T")).select("entity", period.alias("period"), F.pmod("t", F.lit(length)).cast("int").alias("t"), "b", F.lit(length).alias("__T"))
    hits = whole.where("b = 1")
    own = near(hits, ["period", "entity"], "b", lag).groupBy("period").agg(F.sum(F.col("b") * F.col("near")).alias("__own"))
    every = near(hits.groupBy("period", "t", "__T").agg(F.sum("b").alias("k")), ["period"], "k", lag).groupBy("period").agg(F.sum(F.col("k") * F.col("near")).alias("__all"))
    stats = whole.select("period").distinct().join(every, "period", "left").join(own, "period", "left").select("period", ((F.coalesce("__all", F.lit(0)) - F.coalesce("__own", F.lit(0))) / 2).alias("__s"))
    last = stats.agg(F.max_by("__s", "period").alias("stat"), F.max("period").alias("__last"))
    past = stats.crossJoin(F.broadcast(last)).where("period < __last").groupBy("stat").agg(F.count_if(F.col("__s") >= F.col("stat")).alias("__above"), F.count(F.lit(1)).alias("__n"))
    return last.join(past, "stat", "left").select("stat", ((F.coalesce("__above", F.lit(0)) + 1) / (F.coalesce("__n", F.lit(0)) + 1)).alias("p"))
