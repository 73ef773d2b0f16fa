"""Cutting lineage through the shared checkpoint folder, and small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="noveltybench-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/noveltybench-{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the gateway may be gone already
            pass

    atexit.register(drop)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later jobs survive lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """The schema of ``df`` with more fields (name, type); ``df.schema`` itself stays as it is."""
    out = StructType(list(df.schema.fields))
    for name, kind in fields:
        out = out.add(name, DataType.fromDDL(kind))
    return out
