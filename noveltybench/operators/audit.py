"""Audits of a raw table: counts, non-finite cells, label consistency, order and time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite(c: str) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) < INFINITY), F.col(c))


def shape_types(df: DataFrame) -> DataFrame:
    """(column, type, rows) of each column."""
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
    return types.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("rows"))))


def nan_inf(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nan, inf) in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.isnan(c)).alias("nan"), F.count_if(F.abs(F.col(c)) == INFINITY).alias("inf")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def label_consistency(df: DataFrame, label: str, cls: str) -> DataFrame:
    """One row: rows whose binary label contradicts their class."""
    wrong = (F.col(label) == 0) != (F.lower(cls) == "benign")
    return df.agg(F.count_if(wrong).alias("inconsistent"))


def time_range(df: DataFrame, time: str) -> DataFrame:
    t = F.when(~F.isnan(time), F.col(time))
    return df.agg(F.min(t).alias("first"), F.max(t).alias("last"), ((F.max(t) - F.min(t)) / 3_600_000.0).alias("span_hours"), F.count_if(F.isnan(time)).alias("nan"))


def sorted_by_id(df: DataFrame, time: str, row_id: str, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """One row: does time never fall in order of row id?

    Rows are checked inside chunks of ids and chunk ends against each other, so no task sorts the whole table.
    """
    chunk = F.floor(F.col(row_id) / rows_per_chunk)
    inside = df.select(chunk.alias("__c"), F.col(row_id).alias("__i"), F.col(time).alias("__t"))
    w = Window.partitionBy("__c").orderBy("__i")
    falls = inside.withColumn("__f", F.lag("__t").over(w) > F.col("__t")).groupBy("__c").agg(F.count_if("__f").alias("falls"), F.min_by("__t", "__i").alias("a"), F.max_by("__t", "__i").alias("b"))
    ends = falls.withColumn("__g", F.lag("b").over(Window.orderBy("__c")) > F.col("a"))
    return ends.agg((F.sum("falls") + F.count_if("__g")).alias("falls")).withColumn("is_sorted", F.col("falls") == 0)


def end_before_start(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.agg(F.count_if(F.col(end) < F.col(start)).alias("end_before_start"))


def reconcile(counts: DataFrame, published: DataFrame) -> DataFrame:
    """(name, file_n, published_n, status): full comparison of class counts, names compared without case."""
    a = counts.select(F.col("value").alias("file_name"), F.col("n").alias("file_n"))
    b = published.select(F.col("value").alias("published_name"), F.col("n").alias("published_n"))
    both = a.join(b, F.lower("file_name") == F.lower("published_name"), "full_outer")
    status = (
        F.when(F.col("file_name").isNull(), "missing")
        .when(F.col("published_name").isNull(), "extra")
        .when(F.col("file_n") != F.col("published_n"), "count differs")
        .when(F.col("file_name") != F.col("published_name"), "case differs")
        .otherwise("match")
    )
    return both.select(F.coalesce("file_name", "published_name").alias("name"), "file_n", "published_n", status.alias("status"))


def schema_check(df: DataFrame, expected: list[str]) -> DataFrame:
    """(name, status) of expected columns (ok or missing) and of unexpected ones."""
    rows = [(c, "ok" if c in df.columns else "missing") for c in expected] + [(c, "unexpected") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "name string, status string")
