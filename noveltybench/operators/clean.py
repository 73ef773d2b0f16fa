"""Cleaning fitted on training rows only, its parameters as a table, and its use elsewhere.

Parameters: one row a feature with median (of finite values, 0 without any),
log1p flag, mean and population deviation after imputing and log1p, and a drop
reason if the feature isn't kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltybench.operators.audit import finite
from noveltybench.operators.ranks import quantile

EPSILON = 1e-12
#: Sums in another order move means and deviations by less than this share of a feature's scale.
ROUNDING = 1e-9


def fit(train: DataFrame, columns: list[str], heavy: list[str]) -> DataFrame:
    """(place, feature, median, log1p, mean, std, dropped) of each numeric feature."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).cast("double").alias("value")) for c in columns])).alias("cell")).select("cell.*")
    middle = quantile(long, ["feature"], "value", 0.5, "median")
    medians = middle.agg(*[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("median"))), F.lit(0.0)).alias(f"__m_{c}") for c in columns])
    lowest = train.agg(*[F.min(finite(c)).alias(f"__lo_{c}") for c in columns])
    joined = train.crossJoin(F.broadcast(medians)).crossJoin(F.broadcast(lowest))

    def log_flag(c: str) -> Column:
        lowest = F.least(F.coalesce(F.col(f"__lo_{c}"), F.col(f"__m_{c}")), F.col(f"__m_{c}"))
        return F.lit(c in heavy) & (lowest >= 0)

    def value(c: str) -> Column:
        x = F.coalesce(finite(c), F.col(f"__m_{c}"))
        return F.when(log_flag(c), F.log1p(F.greatest(x, F.lit(0.0)))).otherwise(x)

    stats = joined.agg(
        F.array(
            *[
                F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.max(f"__m_{c}").alias("median"), F.max(log_flag(c)).alias("log1p"), F.avg(value(c)).alias("mean"), F.stddev_pop(value(c)).alias("std"))
                for i, c in enumerate(columns)
            ]
        ).alias("p")
    )
    params = stats.select(F.inline("p"))
    return params.withColumn("dropped", F.when(F.isnan("std") | (F.col("std") <= EPSILON), "zero variance"))


def correlation_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns, in column order, from one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    parts = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.corr(columns[i], columns[j]).alias("r")) for i, j in pairs]
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def correlation_prune(pairs: list[tuple[str, str, float]], columns: list[str], limit: float = 0.999999) -> dict[str, str]:
    """Later column -> the earlier kept column it repeats, decided in column order."""
    r = {(a, b): x for a, b, x in pairs}
    dropped: dict[str, str] = {}
    for i, a in enumerate(columns):
        if a in dropped:
            continue
        for b in columns[i + 1 :]:
            x = r.get((a, b))
            if b not in dropped and x is not None and abs(x) >= limit:
                dropped[b] = a
    return dropped


def transform(rows: DataFrame, params: list[dict], keep: list[str] | None = None) -> DataFrame:
    """Other columns and the kept features, imputed, log1p'd (negatives first set to 0) and standardised."""
    chosen = [p for p in params if p["dropped"] is None and (keep is None or p["feature"] in keep)]
    features = {p["feature"] for p in params}

    def cleaned(p: dict) -> Column:
        x = F.coalesce(finite(p["feature"]), F.lit(p["median"]))
        if p["log1p"]:
            x = F.log1p(F.greatest(x, F.lit(0.0)))
        return ((x - F.lit(p["mean"])) / F.lit(p["std"])).alias(p["feature"])

    return rows.select(*[c for c in rows.columns if c not in features], *[cleaned(p) for p in chosen])


def common_features(params: list[DataFrame]) -> DataFrame:
    """(feature) kept by every parameter table."""
    kept = reduce(DataFrame.unionByName, [p.where("dropped is null").select("feature") for p in params])
    return kept.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(params)).select("feature")


def differing(params: DataFrame, other: DataFrame) -> DataFrame:
    """(feature) of which any parameter differs, or that one of the tables lacks.

    Places, medians, flags and drop reasons must be equal.  Fits of the same rows add them up in different orders, so means
    and deviations must be equal up to ROUNDING times the smaller scale (mean or deviation) of the two.
    """
    names = ["place", "median", "log1p", "mean", "std", "dropped"]
    sides = [p.select("feature", F.struct(*names).alias(side)) for p, side in ((params, "__a"), (other, "__b"))]

    def equal(c: str) -> Column:
        return F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))

    def scale(side: str) -> Column:
        return F.greatest(F.abs(F.col(f"{side}.mean")), F.col(f"{side}.std"))

    def close(c: str) -> Column:
        gap = F.abs(F.col(f"__a.{c}") - F.col(f"__b.{c}"))
        return equal(c) | F.coalesce(gap <= F.lit(ROUNDING) * F.least(scale("__a"), scale("__b")), F.lit(False))

    same = reduce(lambda a, c: a & (close(c) if c in ("mean", "std") else equal(c)), names, F.lit(True))
    return sides[0].join(sides[1], "feature", "full_outer").where(~same).select("feature")


def restrict(params: DataFrame, frozen: list[str]) -> DataFrame:
    """The parameters of the frozen features; an error if one of them is missing or was dropped in fitting."""
    wanted = params.sparkSession.createDataFrame([(c,) for c in frozen], "feature string")
    kept = F.broadcast(wanted).join(params.where("dropped is null").withColumn("__there", F.lit(True)), "feature", "left")
    lost = F.raise_error(F.concat(F.lit("dropped on these rows: "), F.col("feature"))).cast("boolean")
    return kept.where(F.coalesce("__there", lost)).drop("__there")


def compact_rows(referenced: DataFrame) -> DataFrame:
    """(grp, rn, compact): the flows that any referenced window covers, numbered anew within their block."""
    from pyspark.sql import Window

    return referenced.select("grp", "rn").distinct().withColumn("compact", (F.row_number().over(Window.partitionBy("grp").orderBy("rn")) - 1).cast("long"))
