"""Queries: scans, sinks, archives and manifests over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noveltybench.operators import splits as S
from noveltybench.operators import verify as V
from noveltybench.operators import windows as W
from noveltybench.plans.base import SEED, query, table
from noveltybench.plans.clean_plans import params
from noveltybench.plans.metric_plans import CUBE, result_cube
from noveltybench.plans.window_plans import PLACED, SETS, numbered, placed
from noveltybench.plans.base import windowed, with_sql
from noveltybench.sources import tables as T


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_typed(spark, sf):
    """Customers written as CSV with padded labels, and read with fixed types."""
    path = T.shared_path(spark, "csv")
    c = table(spark, sf, "customer")
    c.withColumn("c_mktsegment", F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return T.scan_csv(spark, path, c.schema, ["c_mktsegment"])


@query('SELECT count(*) AS "rows" FROM orders')
def scan_row_count_guard(spark, sf):
    """Orders written in two parts and read as one table, against the count recorded when they were written."""
    path, orders = T.shared_path(spark, "guarded"), table(spark, sf, "orders")
    recorded = 0
    for odd in (0, 1):
        part = orders.where(F.col("o_orderkey") % 2 == odd)
        part.write.parquet(f"{path}/part={odd}")
        recorded += part.count()
    return T.guarded_count(spark.read.parquet(path), recorded)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def scan_limit_rows(spark, sf):
    """The first 50 orders by key (the operator's feature is a limit)."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(50)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_parquet_columns(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").where("l_quantity > 45")


@query("SELECT event_id, value FROM events WHERE event_id IN (SELECT o_orderkey * 3 FROM orders)")
def scan_rows_by_position(spark, sf):
    chosen = table(spark, sf, "orders").select((F.col("o_orderkey") * 3).alias("event_id"))
    return T.rows_by_position(table(spark, sf, "events").select("event_id", "value"), chosen, "event_id")


@query("SELECT event_id, dayname(ts) AS day, CAST((isodow(ts) - 1) AS INTEGER) AS day_rank FROM events")
def union_day_files(spark, sf):
    e = table(spark, sf, "events")
    names = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    parts = {n: e.where(F.weekday("ts") == i).select("event_id") for i, n in enumerate(names)}
    return T.union_tagged(parts, "day")


@query("SELECT count(*) AS rows_written, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events")
def sink_parquet_rowgroups(spark, sf):
    path = T.shared_path(spark, "groups")
    T.write_row_groups(table(spark, sf, "events"), path, ["ts", "event_id"], 100_000)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_written"), F.countDistinct("user_id").alias("users"))


def _archive(spark, sf):
    path = T.shared_path(spark, "archive")
    p = placed(spark, sf)
    T.write_archive(path, numbered(spark, sf), p, S.make_sets(p, SEED), params(spark, sf))
    return path


@query(windowed("SELECT set_name, count(*) AS windows FROM sets GROUP BY set_name", *SETS))
def sink_archive(spark, sf):
    return spark.read.parquet(f"{_archive(spark, sf)}/membership").groupBy("set_name").agg(F.count(F.lit(1)).alias("windows"))


@query(windowed("SELECT window_id, grp, k, y_cls, split FROM placed JOIN (SELECT window_id FROM sets WHERE set_name = 'test') USING (window_id)", *SETS))
def source_archive(spark, sf):
    return T.archive_windows(spark, _archive(spark, sf), "test").select("window_id", "grp", "k", "y_cls", "split")


@query(windowed("SELECT set_name, window_id, CAST(row_number() OVER (PARTITION BY set_name ORDER BY window_id) - 1 AS BIGINT) AS local_index, grp, split, first_row FROM sets JOIN placed USING (window_id) JOIN (SELECT grp, k, row_id AS first_row FROM exploded WHERE pos = 0) USING (grp, k)", *SETS))
def export_split_release(spark, sf):
    p = placed(spark, sf)
    flows = numbered(spark, sf).select("grp", F.col("rn").alias("start_rn"), F.col("row_id").alias("first_row"))
    rows = S.make_sets(p, SEED).drop("y_bin").join(p, "window_id").join(flows, ["grp", "start_rn"])
    place = F.row_number().over(W.Window.partitionBy("set_name").orderBy("window_id")) - 1
    return rows.select("set_name", "window_id", place.cast("long").alias("local_index"), "grp", "split", "first_row")


@query(with_sql("SELECT cls, detector, seed, round(auc, 9) AS auc FROM cube0", CUBE))
def scan_results_json(spark, sf):
    """Run records written as JSON and read back as a long table."""
    path = T.shared_path(spark, "runs")
    result_cube(spark, sf).withColumn("kind", F.lit("run")).write.partitionBy("seed").json(path)
    runs = spark.read.schema("cls int, detector string, auc double, kind string").option("recursiveFileLookup", False).json(path)
    return runs.where("kind = 'run'").select("cls", "detector", F.col("seed").cast("long").alias("seed"), F.round("auc", 9).alias("auc"))


@query(with_sql("SELECT seed, count(*) AS cells FROM cube0 GROUP BY seed", CUBE))
def sink_results_json(spark, sf):
    path = T.shared_path(spark, "json")
    result_cube(spark, sf).select("cls", "detector", "auc", F.col("seed").alias("run")).write.json(path)
    return spark.read.schema("cls int, detector string, auc double, run long").json(path).groupBy(F.col("run").alias("seed")).agg(F.count(F.lit(1)).alias("cells"))


FILES = [("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")]


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS \"rows\", (SELECT string_agg(column_name, ',') FROM (DESCRIBE {t})) AS columns FROM {t}" for t, _ in FILES))
def content_manifest(spark, sf):
    """Rows and columns of the tables kept as one file each; digests are compared in ``manifest_immutability``."""
    return T.content_manifest(spark, sf).where(F.col("name").isin([f"{t}.parquet" for t, _ in FILES])).select("name", "rows", "columns")


REGISTERED = """old AS (SELECT chr(CAST(97 + s_suppkey % 5 AS INTEGER)) AS name, s_suppkey, s_name, s_acctbal FROM supplier),
later AS (SELECT * FROM old WHERE name IN ('a', 'd') UNION ALL SELECT * FROM old WHERE name = 'b' AND s_suppkey > 1 UNION ALL SELECT name, s_suppkey, s_name, s_acctbal + 1 FROM old WHERE name = 'c' UNION ALL SELECT 'f', s_suppkey, s_name, s_acctbal FROM old WHERE name = 'e'),
a AS (SELECT name, count(*) AS n, sum(CAST(hash(s_suppkey, s_name, s_acctbal) AS HUGEINT)) AS h FROM old GROUP BY name),
b AS (SELECT name, count(*) AS n, sum(CAST(hash(s_suppkey, s_name, s_acctbal) AS HUGEINT)) AS h FROM later GROUP BY name)"""


@query(with_sql("SELECT name, change FROM (SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.n IS NULL THEN 'gone' WHEN a.n IS NULL THEN 'new' WHEN a.n <> b.n THEN 'rows' WHEN a.h <> b.h THEN 'digest' END AS change FROM a FULL JOIN b ON a.name = b.name) WHERE change IS NOT NULL", REGISTERED))
def manifest_immutability(spark, sf):
    """Suppliers in five folders against the manifest written before rows went from one, changed in one, and one moved."""
    path = T.shared_path(spark, "registered")
    suppliers = table(spark, sf, "supplier").withColumn("__name", F.chr(F.lit(97) + F.col("s_suppkey") % 5))
    part = {name: suppliers.where(F.col("__name") == name).drop("__name") for name in "abcde"}
    for name, rows in part.items():
        rows.write.parquet(f"{path}/{name}")
    T.content_manifest(spark, path, folders=True).write.parquet(f"{path}-manifest")
    part["b"].where("s_suppkey > 1").write.mode("overwrite").parquet(f"{path}/b")
    part["c"].withColumn("s_acctbal", F.col("s_acctbal") + 1).write.mode("overwrite").parquet(f"{path}/c")
    T.remove(spark, f"{path}/e")
    part["e"].write.parquet(f"{path}/f")
    return T.manifest_changes(spark.read.parquet(f"{path}-manifest"), T.content_manifest(spark, path, folders=True))


@query(windowed("SELECT grp, rn, CAST(row_number() OVER (PARTITION BY grp ORDER BY rn) - 1 AS BIGINT) AS compact FROM (SELECT DISTINCT e.grp, e.rn FROM exploded e JOIN labels l ON l.grp = e.grp AND l.k = e.k WHERE l.n_attack >= 3)"))
def compact_rows(spark, sf):
    from noveltybench.operators.clean import compact_rows as compact
    from noveltybench.plans.window_plans import STRIDE, SIZE, windows

    chosen = windows(spark, sf).where("n_attack >= 3").select("grp", "k")
    return compact(W.materialize_windows(chosen, numbered(spark, sf), SIZE, STRIDE).select("grp", "rn"))
