"""Ranks of each step among all earlier steps of its series, for series of any length.

A series that fits in one slice is ranked by one task.  A longer one is cut into slices of time; a step's earlier
steps are then those of its own slice, ranked there, and those of earlier slices.  The latter are counted over a grid
of slices and buckets of values: whole cells by sums carried over the grid, the cells of the step's own bucket by
comparing the bucket's values, of which equal ones of a slice are one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.operators.ranks import running
from noveltybench.sources.tables import shared_path

#: Steps that one task ranks, and slices of a series at most (longer series take longer slices).
SLICE_ROWS, SLICES = 100_000, 1_000


def earlier_greater(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place of a sequence, the weight of the earlier places that hold a greater value."""
    n, total = len(values), np.zeros(len(values), np.int64)
    falling = np.lexsort((-np.arange(n), -values))  # of equal values the later comes first, so it doesn't count the earlier
    for level in range(max(n - 1, 0).bit_length()):
        order = falling[np.argsort(falling >> (level + 1), kind="stable")]
        left = (order >> level) & 1 == 0
        so_far = np.cumsum(np.where(left, weights[order], 0))
        before_block = np.concatenate([[0], so_far])[(order >> (level + 1)) << (level + 1)]
        total[order] += np.where(left, 0, so_far - before_block)
    return total


def earlier_equal(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place of a sequence, the weight of the earlier places that hold the same value."""
    order = np.argsort(values, kind="stable")
    before = np.cumsum(weights[order]) - weights[order]
    first = np.ones(len(values), bool)
    first[1:] = values[order][1:] != values[order][:-1]
    out = np.zeros(len(values), np.int64)
    out[order] = before - before[first][np.cumsum(first) - 1]
    return out


def _stored(rows: DataFrame, what: str) -> DataFrame:
    path = shared_path(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def past_ranks(series: DataFrame, column: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(entity, t, x, place, above, same): steps before this one, those of a greater and those of the same value.

    Rows without entity, time or value, and NaN, are no steps.  A series has one row a time; rows that repeat a time
    follow one another by value, and count as steps.  Answers don't depend on ``slice_rows``.
    """
    kinds = {c: series.schema[c].dataType.simpleString() for c in ("entity", "t")}
    x = F.col(column).cast("double")
    rows = series.select("entity", "t", x.alias("x")).where(F.col("entity").isNotNull() & F.col("t").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    schema = f"entity {kinds['entity']}, t {kinds['t']}, slice long, x double, place long, above long, same long"

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "x"], ignore_index=True)
        v, ones = pdf["x"].to_numpy(), np.ones(len(pdf), np.int64)
        return pdf[["entity", "t", "slice", "x"]].assign(place=np.arange(len(v)), above=earlier_greater(v, ones), same=earlier_equal(v, ones))

    longest = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= slice_rows:
        return rows.withColumn("slice", F.lit(0).cast("long")).groupBy("entity", "slice").applyInPandas(inside, schema).drop("slice")
    size = max(slice_rows, -(-longest // SLICES))

    times = rows.groupBy("entity", "t").agg(F.count(F.lit(1)).alias("n"))
    at = running(times, ["entity"], "t", ["n"]).select("entity", "t", F.floor(F.col("n_before") / size).alias("slice"))
    own = _stored(rows.join(at, ["entity", "t"]).groupBy("entity", "slice").applyInPandas(inside, schema), "slices")
    carry = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("entity", "slice").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("entity", "slice", F.coalesce(F.sum("n").over(carry), F.lit(0)).alias("start"))

    # Equal values of a slice are one row, so a value that fills a series is a row a slice; buckets hold about ``size`` rows.
    pairs = own.groupBy("entity", "slice", "x").agg(F.count(F.lit(1)).alias("n"))
    levels = pairs.groupBy("entity", "x").agg(F.count(F.lit(1)).alias("rows"))
    buckets = running(levels, ["entity"], "x", ["rows"]).select("entity", "x", F.floor(F.col("rows_before") / size).alias("bucket"))
    placed = _stored(pairs.join(buckets, ["entity", "x"]).select("entity", "slice", "bucket", "x", "n"), "buckets")

    def border(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["slice", "x"], ignore_index=True)  # rising inside a slice: it adds nothing to itself
        v, n = pdf["x"].to_numpy(), pdf["n"].to_numpy()
        return pdf[["entity", "slice", "bucket", "x"]].assign(near=earlier_greater(v, n), equal=earlier_equal(v, n))

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        s, b = (np.unique(pdf[c], return_inverse=True)[1] for c in ("slice", "bucket"))
        cells = np.zeros((s.max() + 1, b.max() + 1), np.int64)
        cells[s, b] = pdf["n"]
        greater = cells.sum(axis=1, keepdims=True) - cells.cumsum(axis=1)
        return pdf[["entity", "slice", "bucket"]].assign(far=(greater.cumsum(axis=0) - greater)[s, b])

    head = f"entity {kinds['entity']}, slice long, bucket long"
    near = placed.groupBy("entity", "bucket").applyInPandas(border, f"{head}, x double, near long, equal long")
    far = placed.groupBy("entity", "slice", "bucket").agg(F.sum("n").alias("n")).groupBy("entity").applyInPandas(grid, f"{head}, far long")
    earlier = near.join(far, ["entity", "slice", "bucket"]).join(starts, ["entity", "slice"])
    whole = own.join(earlier, ["entity", "slice", "x"])
    return whole.select("entity", "t", "x", (F.col("start") + F.col("place")).alias("place"), (F.col("above") + F.col("near") + F.col("far")).alias("above"), (F.col("same") + F.col("equal")).alias("same"))
