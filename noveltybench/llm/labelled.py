"""Bounded, reproducible samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noveltybench.llm.storage import stored

#: Candidates drawn for each row wanted, so that what is put in order doesn't grow with the table.
SPARE = 2


def fold(key: str, mod: int = 5):
    """crc32 of the key as text, modulo ``mod``."""
    return F.crc32(F.col(key).cast("string")) % mod


def spread_ids(rows: DataFrame, key: str, by: str | None, most: int, seed: int) -> list[tuple]:
    """(label, key) of the ``most`` distinct keys of smallest hash for each value of ``by``, all where there are no more.

    Keys are counted first (about); then only those of the smallest hashes, SPARE * most of them, are made distinct and put
    in order.  Should they be too few, the bound is raised.  A repeated key counts once.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), 1)
    named = rows.where(F.col(key).isNotNull()).select((F.col(by) if by else F.lit(0)).alias("label"), F.col(key).alias("key"), hashed.alias("hash")).where("label is not null")
    sizes = {r["label"]: max(r["n"], 1) for r in named.groupBy("label").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    found: list[tuple] = []
    open_, spare = dict(sizes), SPARE
    while open_:
        limit, whole = F.lit(None).cast("long"), set()
        for label, n in open_.items():
            if n <= spare * most:
                whole.add(label)
            limit = F.when(F.col("label") == label, F.lit(2**63 - 1 if label in whole else int(2**63 * (spare * most / n)))).otherwise(limit)
        place = F.row_number().over(Window.partitionBy("label").orderBy("hash", "key"))
        got = [(r["label"], r["key"]) for r in named.where(F.col("hash") <= limit).distinct().withColumn("place", place).where(F.col("place") <= most).collect()]
        done = {label for label in open_ if label in whole or sum(x == label for x, _ in got) >= most}
        found += [(label, k) for label, k in got if label in done]
        open_ = {label: n for label, n in open_.items() if label not in done}
        spare *= 8
    return sorted(found)


def one_text(docs: DataFrame, key: str, text: str, sample: DataFrame) -> DataFrame:
    """``sample`` (column ``key`` and others, a bounded table) with the text of each key: of rows that share it, the one of smallest hash.

    Written to the shared folder, as fits read it more than once.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    met = texts.join(F.broadcast(sample), "key")  # the sample is bounded by its parameters
    first = met.groupBy(*sample.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return stored(first, "learned")
