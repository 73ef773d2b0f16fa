"""Registration of queries with their SQL, and the fixture views both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltybench.sources.tables import remove, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Production parameters of the window fixtures.
SIZE, STRIDE, BLOCK_MS, SEED = 4, 2, 86_400_000.0, 17


def query(sql: str | None = None, name: str | None = None):
    """Registers a query function under its name; without SQL it has a rows-only check and a test of its own."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


_KEPT: dict[tuple[str, str, str], tuple[SparkSession, str]] = {}


def kept(name: str):
    """A fixture that fans out to several readers: written once to the shared folder for an application and data folder.

    Readers scan the table, so their plans stay short, no executor holds it in memory and a lost one costs nothing.
    ``forget`` removes all such tables, and so does the end of the application.
    """

    def wrap(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def get(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf, f"{name}{late}")
            if key not in _KEPT:
                path = shared_path(spark, name)
                (make(spark, sf, late) if late else make(spark, sf)).write.parquet(path)
                _KEPT[key] = (spark, path)
            return spark.read.parquet(_KEPT[key][1])

        return get

    return wrap


def forget() -> None:
    """Removes all kept fixtures."""
    for spark, path in _KEPT.values():
        remove(spark, path)
    _KEPT.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def millis(column: str):
    """Epoch milliseconds of a time stamp that has no zone (UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1000.0)


def flows(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    """Flow fixture: row_id, t_ms, user_id, f1, f2, cls; click, signup and view are benign.

    ``late`` renames errors in the last 15 % of the time span, and makes the earlier ones purchases.
    """
    events = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), millis("ts").alias("t_ms"), "user_id", F.col("value").alias("f1"), F.get_json_object("props", "$.k").cast("double").alias("f2"), "event_type")
    cls = F.when(F.col("event_type").isin("click", "signup", "view"), "Benign").otherwise(F.col("event_type"))
    if late:
        span = events.agg((F.min("t_ms") + 0.85 * (F.max("t_ms") - F.min("t_ms"))).alias("__cut"))
        events = events.crossJoin(F.broadcast(span))
        cls = F.when(F.col("event_type") != "error", cls).when(F.col("t_ms") >= F.col("__cut"), "late").otherwise("purchase")
    return events.withColumn("cls", cls).drop("event_type", "__cut")


FLOWS = """flows AS (
  SELECT event_id AS row_id, epoch_us(ts) / 1000.0 AS t_ms, user_id, value AS f1, CAST(json_extract(props, '$.k') AS DOUBLE) AS f2,
         CASE WHEN event_type IN ('click', 'signup', 'view') THEN 'Benign' ELSE event_type END AS cls
  FROM events)"""
FLOWS_LATE = """flows AS (
  SELECT event_id AS row_id, epoch_us(ts) / 1000.0 AS t_ms, user_id, value AS f1, CAST(json_extract(props, '$.k') AS DOUBLE) AS f2,
         CASE WHEN event_type IN ('click', 'signup', 'view') THEN 'Benign' WHEN event_type <> 'error' THEN event_type
              WHEN epoch_us(ts) / 1000.0 >= (SELECT min(epoch_us(ts) / 1000.0) + 0.85 * (max(epoch_us(ts) / 1000.0) - min(epoch_us(ts) / 1000.0)) FROM events) THEN 'late' ELSE 'purchase' END AS cls
  FROM events)"""
WINDOWED = """blocked AS (
  SELECT f.*, CAST(floor((t_ms - (SELECT min(t_ms) FROM flows)) / 86400000.0) AS BIGINT) AS block FROM flows f
), grps AS (
  SELECT block, CAST(row_number() OVER (ORDER BY block) - 1 AS INTEGER) AS grp FROM (SELECT DISTINCT block FROM blocked)
), timed AS (
  SELECT b.*, g.grp FROM blocked b JOIN grps g USING (block)
), codes AS (
  SELECT cls, CAST(CASE WHEN lower(cls) = 'benign' THEN 0 ELSE row_number() OVER (PARTITION BY lower(cls) = 'benign' ORDER BY cls) END AS INTEGER) AS code
  FROM (SELECT DISTINCT cls FROM flows)
), numbered AS (
  SELECT t.*, c.code, row_number() OVER (PARTITION BY grp ORDER BY t_ms, row_id) - 1 AS rn FROM timed t JOIN codes c USING (cls)
), sizes AS (
  SELECT grp, count(*) AS m FROM numbered GROUP BY grp
), starts AS (
  SELECT grp, unnest(range(0, (m - 4) // 2 + 1)) AS k FROM sizes WHERE m >= 4
), exploded AS (
  SELECT n.*, s.k, CAST(n.rn - s.k * 2 AS INTEGER) AS pos FROM starts s JOIN numbered n ON n.grp = s.grp AND n.rn >= s.k * 2 AND n.rn < s.k * 2 + 4
), percls AS (
  SELECT grp, k, code, count(*) AS n, min(rn) AS first FROM exploded GROUP BY grp, k, code
), best AS (
  SELECT grp, k, max(n) AS top FROM percls WHERE code > 0 GROUP BY grp, k
), labels AS (
  SELECT p.grp, CAST(p.k AS BIGINT) AS k, min(p.first) AS start_rn, CAST(max(CASE WHEN code > 0 THEN 1 ELSE 0 END) AS INTEGER) AS y_bin,
         CAST(coalesce(min(code) FILTER (code > 0 AND n = top), 0) AS INTEGER) AS y_cls,
         CAST(count(*) FILTER (code > 0 AND n = top) AS INTEGER) AS n_modes,
         coalesce(max(top), 4) / 4.0 AS purity, CAST(sum(1 << code) AS BIGINT) AS class_mask,
         CAST(coalesce(sum(n) FILTER (code > 0), 0) AS BIGINT) AS n_attack
  FROM percls p LEFT JOIN best b ON b.grp = p.grp AND b.k = p.k GROUP BY p.grp, p.k
), win AS (
  SELECT *, CAST(grp AS BIGINT) * 4294967296 + k AS window_id FROM labels
)"""


def split_sql(order: str, gap: bool) -> str:
    """The (grp, n, split) table of a window table ``win``."""
    gap_case = "WHEN sum(CASE WHEN before < 0.6 * total THEN 0 ELSE 1 END) OVER (ORDER BY {o}, grp) = 1 THEN 'gap'".format(o=order) if gap else ""
    return f"""gsize AS (
  SELECT grp, count(*) AS n FROM win GROUP BY grp
), cumul AS (
  SELECT grp, n, coalesce(sum(n) OVER (ORDER BY {order}, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM gsize
), split AS (
  SELECT grp, n, CASE WHEN before < 0.6 * total THEN 'train' {gap_case} WHEN before < 0.8 * total THEN 'val' ELSE 'test' END AS split FROM cumul
)"""


SPLIT_GAP = split_sql("grp", True)
SPLIT_RANDOM = split_sql("md5(grp || ':17')", False)
PLACED = "placed AS (SELECT w.*, s.split FROM win w JOIN split s USING (grp))"


def balance_sql(source: str, out: str, ratio: int, cap: int, by: str = "") -> str:
    """CTE ``out``: an exact-ratio sample of CTE ``source``; ``by`` is a column list inside which it holds."""
    part = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN {out}_q q USING ({by})" if by else f"CROSS JOIN {out}_q q"
    return f"""{out}_q AS (
  SELECT {part}least(count(*) FILTER (y_bin = 1), {cap // (1 + ratio)}, (count(*) FILTER (y_bin = 0)) // {ratio}) AS na FROM {source} {group}
), {out}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {part}y_bin ORDER BY md5(window_id || ':17'), window_id) AS place FROM {source}
), {out} AS (
  SELECT r.* EXCLUDE (place) FROM {out}_r r {join} WHERE place <= CASE WHEN y_bin = 1 THEN na ELSE na * {ratio} END
)"""


def with_sql(select: str, *parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n" + select


def windowed(select: str, *parts: str, late: bool = False) -> str:
    return with_sql(select, FLOWS_LATE if late else FLOWS, WINDOWED, *parts)
