"""Queries: streaming operators over the event table, drained to what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from noveltybench.plans.base import query, table
from noveltybench.sources.tables import shared_path
from noveltybench.streaming import sequential


def events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf)
    return raw.select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("score"))


@query("""WITH RECURSIVE s AS (SELECT user_id AS entity, list(value ORDER BY ts, value) AS v FROM events GROUP BY user_id),
w AS (SELECT entity, v, 0 AS i, 0.0::DOUBLE AS p, FALSE AS hit FROM s UNION ALL SELECT entity, v, i + 1, CASE WHEN greatest(0, p + v[i + 1] - 12) >= 60 THEN 0 ELSE greatest(0, p + v[i + 1] - 12) END, greatest(0, p + v[i + 1] - 12) >= 60 FROM w WHERE i < len(v))
SELECT entity, CAST(count(*) FILTER (i > 0) AS BIGINT) AS steps, CAST(count(*) FILTER (hit) AS BIGINT) AS alarms FROM w GROUP BY entity""")
def stream_cusum_alarms(spark, sf):
    """Steps and alarms of each entity from the stateful stream."""
    out = sequential.drain(sequential.cusum(events_stream(spark, sf), 12.0, 60.0), shared_path(spark, "stream"))
    return out.groupBy("entity").agg(F.count(F.lit(1)).alias("steps"), F.count_if("alarm").alias("alarms"))


@query("""SELECT start, entity, total, n FROM (SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') AS start, user_id AS entity, sum(value) AS total, count(*) AS n FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 HOUR FROM events)""")
def stream_windowed_sums(spark, sf):
    """Daily sums of windows that the watermark has closed."""
    return sequential.drain(sequential.windowed_sums(events_stream(spark, sf), "1 day", "1 hour"), shared_path(spark, "stream"))
