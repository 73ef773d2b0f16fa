"""Typed scans, guarded scans, archives and manifests."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noveltybench.operators.audit import finite
from noveltybench.operators.clean import compact_rows, transform
from noveltybench.operators.windows import materialize_windows


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder all executors see (spark.checkpoint.dir, or what setCheckpointDir chose), removed when the application ends.

    A temporary folder serves only where neither is set and Spark runs in one process (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = chosen.get() if chosen.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/noveltybench-{what}-{uuid.uuid4().hex}"

    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone already
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, trim: list[str] | None = None) -> DataFrame:
    """CSV with a header and fixed column types; label columns are trimmed; malformed rows are errors."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.withColumns({c: F.trim(c) for c in trim or []})


def guarded_count(df: DataFrame, expected: int) -> DataFrame:
    """One row with the row count; an error if it isn't the manifest's."""
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    wrong = F.concat(F.lit("rows read: "), F.col("rows").cast("string"), F.lit(f", expected: {expected}"))
    return n.select(F.when(F.col("rows") != expected, F.raise_error(wrong).cast("long")).otherwise(F.col("rows")).alias("rows"))


def rows_by_position(df: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    return df.join(positions, key, "left_semi")


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Parts in the given order, each row tagged with its part's name and rank."""
    out = None
    for rank, (name, df) in enumerate(parts.items()):
        tagged = df.withColumn(tag, F.lit(name)).withColumn(f"{tag}_rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def write_row_groups(df: DataFrame, path: str, order: list[str], rows_per_file: int = 2_000_000) -> None:
    """Parquet in time order: range partitions, sorted inside, bounded rows a file."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_archive(path: str, flows: DataFrame, windows: DataFrame, membership: DataFrame, params: DataFrame) -> None:
    """Flows, windows, set membership and cleaner parameters below one folder."""
    flows.write.parquet(f"{path}/flows")
    windows.write.parquet(f"{path}/windows")
    membership.write.partitionBy("set_name").parquet(f"{path}/membership")
    params.write.json(f"{path}/cleaner")


def archive_windows(spark: SparkSession, path: str, set_name: str) -> DataFrame:
    """Windows of one set; a member that isn't among the windows is an error."""
    members = spark.read.parquet(f"{path}/membership").where(F.col("set_name") == set_name).select("window_id")
    windows = spark.read.parquet(f"{path}/windows").withColumn("__there", F.lit(True))
    found = members.join(windows, "window_id", "left")
    # In a filter, so that no projection can prune the check.
    return found.where(F.coalesce("__there", F.raise_error(F.lit("a window of the set isn't in the archive")).cast("boolean"))).drop("__there")


def finalize(path: str, flows: DataFrame, windows: DataFrame, members: DataFrame, params: DataFrame, size: int, stride: int) -> str:
    """Writes the archive of a split: flows that a member window covers, numbered anew and cleaned, with windows and sets."""
    chosen = windows.join(members.select("window_id").distinct(), "window_id", "left_semi")
    referenced = materialize_windows(chosen.select("grp", "k"), flows, size, stride).select("grp", "rn")
    fitted = [r.asDict() for r in params.collect()]  # one row a feature
    cleaned = transform(flows.join(compact_rows(referenced), ["grp", "rn"]), fitted)
    write_archive(path, cleaned, chosen, members, params)
    return path


def archive_report(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """One row of a written archive: flows, windows, features, and violations (values not finite, members without window)."""
    flows, windows = spark.read.parquet(f"{path}/flows"), spark.read.parquet(f"{path}/windows")
    members = spark.read.parquet(f"{path}/membership").select("window_id").distinct()
    odd = reduce(lambda a, b: a | b, [finite(c).isNull() for c in features])
    counted = flows.agg(F.count(F.lit(1)).alias("rows_materialised"), F.count_if(odd).alias("odd"))
    used = members.join(windows.select("window_id", F.lit(True).alias("__there")), "window_id", "left").agg(F.count("__there").alias("windows_referenced"), F.count_if(F.col("__there").isNull()).alias("lost"))
    return counted.crossJoin(F.broadcast(used)).select("rows_materialised", "windows_referenced", F.lit(len([c for c in features if c in flows.columns])).cast("long").alias("n_features"), (F.col("odd") + F.col("lost")).alias("violations"))


def content_manifest(spark: SparkSession, path: str, pattern: str = "*.parquet", folders: bool = False) -> DataFrame:
    """(name, rows, columns, digest) of each Parquet file below ``path``, of any size; or of each folder that holds such files.

    The digest is the sum of the hashes of a file's rows, whatever their order; it is summed in part by the tasks that
    read the file's row groups, so no task holds a file.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    parts = None
    for folder in sorted({_table_of(r["path"], path) for r in listed.collect()}):  # one entry a table
        rows = spark.read.option("recursiveFileLookup", True).parquet(folder)
        row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}), 256)
        digests = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string") for k in (0, 1)]
        hashed = rows.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -2 if folders else -1).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *digests).alias("digest"))
        part = hashed.select("name", "rows", F.lit(",".join(rows.columns)).alias("columns"), "digest")
        parts = part if parts is None else parts.unionByName(part)
    return spark.createDataFrame([], "name string, rows long, columns string, digest string") if parts is None else parts


def _table_of(file: str, path: str) -> str:
    """The table a file belongs to: the file itself, or the folder below ``path`` that holds it."""
    inside = file.split(path.split("://")[-1].rstrip("/") + "/", 1)[1]
    return f"{path.rstrip('/')}/{inside.split('/', 1)[0]}"


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change) of files whose rows, columns or digest differ from the manifest's, that are gone or that are new."""
    a = old.select("name", F.struct("rows", "columns", "digest").alias("__a"))
    both = a.join(new.select("name", F.struct("rows", "columns", "digest").alias("__b")), "name", "full_outer")
    differs = [F.when(F.col(f"__a.{c}") != F.col(f"__b.{c}"), c) for c in ("columns", "rows", "digest")]
    change = F.when(F.col("__b").isNull(), "gone").when(F.col("__a").isNull(), "new").otherwise(F.coalesce(*differs))
    return both.select("name", change.alias("change")).where("change is not null")
