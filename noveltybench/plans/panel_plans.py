"""Queries: panel statistics of daily sums by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltybench.operators import attacks as K
from noveltybench.operators import coordination as C
from noveltybench.operators import panel as P
from noveltybench.plans.base import kept, millis, query, table, with_sql


@kept("panel")
def panel(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.floor(millis("ts") / 86_400_000.0).alias("day"), F.col("value").alias("s"))
    first = e.agg(F.min("day").alias("first"))
    dense = P.dense_panel(e.crossJoin(F.broadcast(first)).select("entity", (F.col("day") - F.col("first")).cast("int").alias("t"), "s"))
    return dense.withColumn("s", F.round("s", 2))


PANEL = """raw AS (SELECT user_id AS entity, CAST(floor(epoch_us(ts) / 1000.0 / 86400000.0) AS INTEGER) AS day, value FROM events),
summed AS (SELECT entity, CAST(day - (SELECT min(day) FROM raw) AS INTEGER) AS t, sum(value) AS s FROM raw GROUP BY entity, day),
panel AS (SELECT e.entity, d.t, round(coalesce(s, 0), 2) AS s FROM (SELECT DISTINCT entity FROM summed) e CROSS JOIN (SELECT DISTINCT t FROM summed) d LEFT JOIN summed x ON x.entity = e.entity AND x.t = d.t)"""
RESIDUAL = "residuals AS (SELECT entity, t, s, round(s - quantile_cont(s, 0.5) OVER (PARTITION BY t), 6) AS residual FROM panel)"
U = "(CAST('0x' || substr(md5(entity || ':' || t), 1, 8) AS BIGINT) / 4294967296.0)"


def residuals(spark, sf):
    return P.median_residual(panel(spark, sf)).withColumn("residual", F.round("residual", 6))


@query(with_sql("SELECT entity, t, residual FROM residuals", PANEL, RESIDUAL))
def panel_median_residual(spark, sf):
    return residuals(spark, sf).select("entity", "t", "residual")


@query(with_sql(f"SELECT p.entity, p.t, ((SELECT count(*) FROM panel r WHERE r.t < 10 AND r.s > p.s) + {U.replace('entity', 'p.entity').replace('t),', 'p.t),')} * ((SELECT count(*) FROM panel r WHERE r.t < 10 AND r.s = p.s) + 1)) / ((SELECT count(*) FROM panel r WHERE r.t < 10) + 1) AS p FROM panel p WHERE p.t >= 10", PANEL))
def pvalue_train_ref(spark, sf):
    return P.p_train_ref(panel(spark, sf), 10)


@query(with_sql(f"SELECT entity, t, (rank() OVER (PARTITION BY t ORDER BY s DESC) - 1 + {U}) / count(*) OVER (PARTITION BY t) AS p FROM panel", PANEL))
def pvalue_peer_rank(spark, sf):
    return P.p_peer_rank(panel(spark, sf))


def lagged_sql(source: str, column: str, out: str = "lagged") -> str:
    return f"""{out} AS (SELECT entity, t, (len(list_filter(past, lambda x: x > v)) + {U} * (len(list_filter(past, lambda x: x = v)) + 1)) / 9.0 AS p FROM (
  SELECT entity, t, {column} AS v, list({column}) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING) AS past FROM {source}) WHERE len(past) = 8)"""


LAGGED = lagged_sql("residuals", "residual")


def lagged(spark, sf):
    return P.p_lagged(residuals(spark, sf), "residual", 8, 2, 1)


@query(with_sql("SELECT entity, t, p FROM lagged", PANEL, RESIDUAL, LAGGED))
def pvalue_lagged_reference(spark, sf):
    return lagged(spark, sf)


@query(with_sql(f"SELECT entity, t, (len(list_filter(past, lambda x: x > v)) + {U} * len(list_filter(past, lambda x: x = v))) / len(past) AS p FROM (SELECT entity, t, residual AS v, list(residual) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS past FROM residuals) WHERE len(past) > 5", PANEL, RESIDUAL))
def pvalue_online_full_past(spark, sf):
    return P.p_full_past(residuals(spark, sf), "residual", 5)


STEPS = "steps AS (SELECT event_type AS entity, event_id AS t, round(value, 2) AS v FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)"


@query(with_sql(f"""SELECT entity, t, (above + {U} * same) / n AS p FROM (
 SELECT p.entity, p.t, count(*) AS n, count(*) FILTER (r.v > p.v) AS above, count(*) FILTER (r.v = p.v) AS same FROM steps p JOIN steps r ON r.entity = p.entity AND r.t <= p.t GROUP BY p.entity, p.t) WHERE n > 50""", STEPS))
def pvalue_online_sliced(spark, sf):
    """All events of a type as one long series, cut into slices of 500 steps (or more: 1,000 slices at most)."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("entity"), F.col("event_id").alias("t"), F.round("value", 2).alias("v"))
    return P.p_full_past(e, "v", 50, 500)


@query(with_sql(f"SELECT entity, t, ((SELECT count(*) FROM panel r WHERE r.t = p.t AND r.s > p.s) + {U.replace('entity', 'p.entity').replace('t),', 'p.t),')} * ((SELECT count(*) FROM panel r WHERE r.t = p.t AND r.s = p.s AND r.entity <> p.entity) + 1)) / (SELECT count(*) FROM panel r WHERE r.t = p.t) AS p FROM panel p", PANEL))
def pvalue_conformal_ties(spark, sf):
    """Each cell against its peers of the same time, ties smoothed."""
    counts = panel(spark, sf).groupBy("t", "s").agg(F.count(F.lit(1)).alias("n"))
    at = P.running(counts, ["t"], "s", ["n"]).join(counts.groupBy("t").agg(F.sum("n").alias("all")), "t")
    rows = panel(spark, sf).join(at, ["t", "s"])
    return rows.select("entity", "t", P.conformal_p(F.col("all") - F.col("n_before") - F.col("n"), F.col("n") - 1, F.col("all") - 1, P.unit("entity", "t")).alias("p"))


MEDIANS = "medians AS (SELECT 0 AS entity, t, round(quantile_cont(s, 0.5), 6) AS m FROM panel GROUP BY t)"


@query(with_sql("SELECT t, p FROM lagged", PANEL, MEDIANS, lagged_sql("medians", "m")))
def pvalue_network_common_mode(spark, sf):
    m = panel(spark, sf).groupBy("t").agg(F.round(F.percentile("s", 0.5), 6).alias("m")).withColumn("entity", F.lit(0))
    return P.p_lagged(m, "m", 8, 2, 1).select("t", "p")


@query(with_sql("SELECT entity, t, (0.5 * pow(a.p, -0.5) + 0.5 * pow(b.p, -0.5)) / 2 AS e FROM lagged a JOIN long_lag b USING (entity, t)", PANEL, RESIDUAL, LAGGED, lagged_sql("residuals", "s", "long_lag")))
def pvalue_multiscale_merge(spark, sf):
    r = residuals(spark, sf)
    b = P.p_lagged(r, "s", 8, 2, 1).withColumnRenamed("p", "q")
    merged = lagged(spark, sf).join(b, ["entity", "t"])
    return merged.select("entity", "t", ((0.5 * F.pow("p", F.lit(-0.5)) + 0.5 * F.pow("q", F.lit(-0.5))) / 2).alias("e"))


@query(with_sql("SELECT entity, t, least(0.5 * pow(p, -0.5), 20.0) AS e FROM lagged", PANEL, RESIDUAL, LAGGED))
def calibrate_power_capped(spark, sf):
    return lagged(spark, sf).select("entity", "t", P.power_e(F.col("p"), 0.5, 20.0).alias("e"))


@query(with_sql("SELECT entity, t, (1 - q + q * ln(q)) / (q * ln(q) * ln(q)) AS e FROM (SELECT entity, t, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM lagged)", PANEL, RESIDUAL, LAGGED))
def calibrate_mixture(spark, sf):
    return lagged(spark, sf).select("entity", "t", P.mixture_e(F.col("p")).alias("e"))


EVAL = "evals AS (SELECT entity, t, least(0.5 * pow(p, -0.5), 20.0) AS e FROM lagged)"


def evals(spark, sf):
    return lagged(spark, sf).select("entity", "t", P.power_e(F.col("p"), 0.5, 20.0).alias("e"))


@query(with_sql("""SELECT entity, t, log_m, min(t) FILTER (log_m >= ln(3.0)) OVER (PARTITION BY entity) AS first_alarm FROM (SELECT entity, t, s - least(0, coalesce(min(s) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS log_m
 FROM (SELECT entity, t, sum(ln(e)) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM evals))""", PANEL, RESIDUAL, LAGGED, EVAL))
def ecusum_no_reset(spark, sf):
    return P.ecusum_no_reset(evals(spark, sf), 3.0)


RESET = """steps AS (SELECT entity, list(e ORDER BY t) AS es, list(t ORDER BY t) AS ts FROM evals GROUP BY entity),
walk AS (SELECT entity, es, ts, 0 AS i, 1.0::DOUBLE AS m, FALSE AS hit FROM steps UNION ALL
 SELECT entity, es, ts, i + 1, CASE WHEN greatest(m, 1.0) * es[i + 1] >= 3.0 THEN 1.0 ELSE greatest(m, 1.0) * es[i + 1] END, greatest(m, 1.0) * es[i + 1] >= 3.0 FROM walk WHERE i < len(es))"""


def recursive(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + "\n" + select


@query(recursive("SELECT entity, CAST(count(*) FILTER (hit) AS BIGINT) AS alarms, min(ts[i]) FILTER (hit) AS first_alarm FROM walk GROUP BY entity", PANEL, RESIDUAL, LAGGED, EVAL, RESET))
def ecusum_reset(spark, sf):
    a = P.ecusum_reset(evals(spark, sf), 3.0)
    return a.select("entity", F.size("alarms").cast("long").alias("alarms"), F.array_min("alarms").alias("first_alarm"))


@query(recursive("SELECT CAST(count(*) FILTER (hit) AS BIGINT) AS alarms, (SELECT count(*) FROM evals) AS steps, 1000 * count(*) FILTER (hit) / (SELECT count(*) FROM evals) AS per_1000 FROM walk", PANEL, RESIDUAL, LAGGED, EVAL, RESET))
def alarm_rate(spark, sf):
    return P.alarm_rate(P.ecusum_reset(evals(spark, sf), 3.0), evals(spark, sf))


@query(recursive("SELECT a.entity, a.t0, min(CASE WHEN w.hit AND ts[i] >= t0 AND ts[i] < t0 + 5 THEN ts[i] END) - t0 AS delay FROM (SELECT entity, arg_max(t, s) AS t0 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, t) AS r FROM panel) WHERE r = 1 GROUP BY entity) a LEFT JOIN walk w USING (entity) GROUP BY a.entity, a.t0", PANEL, RESIDUAL, LAGGED, EVAL, RESET))
def detection_delay(spark, sf):
    """An entity's day of highest activity counts as the start of a five-day attack."""
    top = panel(spark, sf).groupBy("entity").agg(F.max_by("t", F.struct("s", (-F.col("t")).alias("early"))).alias("t0")).withColumn("duration", F.lit(5))
    return P.detection_delay(P.ecusum_reset(evals(spark, sf), 3.0), top)


def attacked(spark, sf):
    """Attacks in four settings: an entity's day of highest activity begins one of 3, of 5 and of 10 days; ``twice`` are two that overlap."""
    top = panel(spark, sf).groupBy("entity").agg(F.max_by("t", F.struct("s", (-F.col("t")).alias("early"))).alias("t0"))
    kinds = [("d3", 0, 3), ("d5", 0, 5), ("d10", 0, 10), ("twice", 0, 5), ("twice", -2, 6)]
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(d).alias("by"), F.lit(n).alias("duration")) for k, d, n in kinds])).alias("a")
    return top.select("entity", "t0", spread).select("entity", "a.setting", (F.col("t0") + F.col("a.by")).alias("t0"), "a.duration")


def alarmed(spark, sf):
    """Evaluated steps with p, e and whether the e-CUSUM with restarts alarms."""
    steps = lagged(spark, sf).withColumn("e", P.power_e(F.col("p"), 0.5, 20.0))
    alarms = P.ecusum_reset(steps.select("entity", "t", "e"), 3.0).select("entity", F.explode("alarms").alias("t"), F.lit(True).alias("alarm"))
    return steps.join(alarms, ["entity", "t"], "left").fillna(False, ["alarm"])


ATTACKED = """top AS (SELECT entity, arg_max(t, s) AS t0 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, t) AS r FROM panel) WHERE r = 1 GROUP BY entity),
attacked AS (SELECT setting, entity, t0 + later AS t0, duration FROM top, (VALUES ('d3', 0, 3), ('d5', 0, 5), ('d10', 0, 10), ('twice', 0, 5), ('twice', -2, 6)) v(setting, later, duration)),
alarmed AS (SELECT l.entity, l.t, l.p, e.e, w.hit IS NOT NULL AS alarm FROM lagged l JOIN evals e USING (entity, t) LEFT JOIN (SELECT entity, ts[i] AS t, hit FROM walk WHERE hit) w ON w.entity = l.entity AND w.t = l.t),
each AS (SELECT a.setting, a.entity, a.t0, a.duration, count(s.t) AS evaluated, CAST(min(CASE WHEN s.alarm THEN s.t END) - a.t0 AS DOUBLE) AS delay, coalesce(sum(ln(s.e)), 0.0) AS log_e, avg(CASE WHEN s.t IS NOT NULL THEN CAST(s.p <= 0.1 AS INTEGER) END) AS share
 FROM attacked a LEFT JOIN alarmed s ON s.entity = a.entity AND s.t >= a.t0 AND s.t < a.t0 + a.duration GROUP BY a.setting, a.entity, a.t0, a.duration)"""


@query(recursive("SELECT setting, entity, t0, duration, evaluated, delay, log_e, share FROM each", PANEL, RESIDUAL, LAGGED, EVAL, RESET, ATTACKED))
def attack_outcomes(spark, sf):
    return K.each_attack(alarmed(spark, sf), attacked(spark, sf), level=0.1)


@query(recursive("SELECT setting, count(*) AS attacks, CAST(sum(evaluated) AS BIGINT) AS windows, avg(CAST(delay IS NOT NULL AS INTEGER)) AS detected, quantile_cont(delay, 0.5) AS median_delay, sum(log_e) / sum(evaluated) AS mean_log_e, CASE WHEN sum(log_e) > 0 THEN ln(3.0) / (sum(log_e) / sum(evaluated)) END AS predicted_delay, avg(share) AS tpr FROM each GROUP BY setting", PANEL, RESIDUAL, LAGGED, EVAL, RESET, ATTACKED))
def detection_delay_summary(spark, sf):
    return K.detection_summary(attack_outcomes(spark, sf), 3.0)


@query(with_sql("SELECT max(greatest(abs(i / n - p), abs(lo / n - p))) AS gap FROM (SELECT p, rank() OVER (ORDER BY p) AS lo, (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1)::DOUBLE AS i, (count(*) OVER ())::DOUBLE AS n FROM lagged)", PANEL, RESIDUAL, LAGGED))
def uniformity_gap(spark, sf):
    return P.uniformity_gap(lagged(spark, sf), [])


B = "exc AS (SELECT entity, t, CAST(s > quantile_cont(s, 0.9) OVER (PARTITION BY entity) AS INTEGER) AS b FROM panel)"
STAT = "(SELECT sum(k * (k - 1) / 2) FROM (SELECT t, sum(b) AS k FROM exc GROUP BY t))"


def exceeded(spark, sf):
    return P.exceedances(panel(spark, sf), "s", 0.1)


@query(with_sql("SELECT entity, t, b FROM exc", PANEL, B))
def exceedance_indicator(spark, sf):
    return exceeded(spark, sf).select("entity", "t", "b")


def stat(rows):
    return rows.withColumn("stat", F.col("stat").cast("double"))


@query(with_sql(f"SELECT CAST({STAT} AS DOUBLE) AS stat", PANEL, B))
def coordination_stat(spark, sf):
    return stat(C.statistic(exceeded(spark, sf)))


#: Hits of a table ``exc`` in bins of four days, and the statistic of a table of hits (perm, entity, t) over n steps.
BINNED = "exc4 AS (SELECT entity, t // 4 AS t, max(b) AS b FROM exc GROUP BY ALL)"


def moved_sql(source: str, draw: str, out: str = "moved") -> str:
    """CTEs: 50 seeded shifts of the hits of ``source`` (n steps), permutation -1 the hits as they are."""
    return f"""line AS (SELECT CAST(max(t) + 1 AS BIGINT) AS n FROM {source}),
{out} AS (SELECT perm, entity, CASE WHEN perm < 0 THEN t ELSE (t + {draw}) % n END AS t, n FROM {source}, line, (SELECT unnest(range(-1, 50)) AS perm) WHERE b = 1)"""


def draws(limit: str) -> str:
    return f"CAST('0x' || substr(md5('3:' || perm || ':' || entity), 1, 8) AS BIGINT) % {limit}"


def pairs_sql(lag: int, source: str = "moved") -> str:
    """CTE ``stats`` (perm, s): pairs of entities that hit at most ``lag`` steps apart."""
    return f"""stats AS (SELECT p.perm, count(b.t) AS s FROM (SELECT unnest(range(-1, 50)) AS perm) p LEFT JOIN (SELECT *, unnest(range(-{lag}, {lag + 1})) AS l FROM {source}) a ON a.perm = p.perm
 LEFT JOIN {source} b ON b.perm = a.perm AND b.entity > a.entity AND b.t = (a.t + a.l + a.n) % a.n GROUP BY p.perm)"""


TESTED = "SELECT CAST(o.s AS DOUBLE) AS stat, (SELECT count(*) + 1 FROM stats WHERE perm >= 0 AND s >= o.s) / 51 AS p FROM stats o WHERE perm = -1"


@query(with_sql("SELECT CAST(s AS DOUBLE) AS stat FROM stats WHERE perm = -1", PANEL, B, moved_sql("exc", "0"), pairs_sql(3)))
def coordination_stat_lag3(spark, sf):
    return stat(C.statistic(exceeded(spark, sf), 3))


@query(with_sql("SELECT CAST(s AS DOUBLE) AS stat FROM stats WHERE perm = -1", PANEL, B, BINNED, moved_sql("exc4", "0"), pairs_sql(0)))
def coordination_stat_bin4(spark, sf):
    return stat(C.statistic(C.binned(exceeded(spark, sf), 4)))


@query(with_sql(f"""SELECT CAST({STAT} AS DOUBLE) AS stat, (count(*) FILTER (s >= {STAT}) + 1) / (count(*) + 1) AS p FROM (SELECT perm, sum(k * (k - 1) / 2) AS s FROM (SELECT perm, (t + CAST('0x' || substr(md5('3:' || perm || ':' || entity), 1, 8) AS BIGINT) % n) % n AS u, count(*) AS k
 FROM exc, (SELECT unnest(range(0, 50)) AS perm), (SELECT max(t) + 1 AS n FROM exc) WHERE b = 1 GROUP BY ALL) GROUP BY perm)""", PANEL, B))
def coordination_circular_test(spark, sf):
    return stat(C.shift_test(exceeded(spark, sf), 50, 3))


@query(with_sql(TESTED, PANEL, B, moved_sql("exc", draws("n")), pairs_sql(3)))
def coordination_circular_lag3_test(spark, sf):
    return stat(C.shift_test(exceeded(spark, sf), 50, 3, lag=3))


@query(with_sql(TESTED, PANEL, B, BINNED, moved_sql("exc4", draws("n")), pairs_sql(0)))
def coordination_circular_bin4_test(spark, sf):
    return stat(C.shift_test(C.binned(exceeded(spark, sf), 4), 50, 3))


@query(with_sql(TESTED, PANEL, B, moved_sql("exc", "7 * (" + draws("(n // 7)") + ")"), pairs_sql(0)))
def coordination_phase_test(spark, sf):
    """Shifts by whole weeks, so weekly habits stay in phase."""
    return stat(C.shift_test(exceeded(spark, sf), 50, 3, period=7))


@query(with_sql("SELECT CAST(max(s) FILTER (period = last) AS DOUBLE) AS stat, (count(*) FILTER (period < last AND s >= now) + 1) / (count(*) FILTER (period < last) + 1) AS p FROM (SELECT *, max(period) OVER () AS last, last_value(s) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM spans)", PANEL,
                "excp AS (SELECT entity, t, t // 5 AS period, CAST(s > quantile_cont(s, 0.9) OVER (PARTITION BY entity, t // 5) AS INTEGER) AS b FROM panel)",
                "spans AS (SELECT period, sum(k * (k - 1) / 2) AS s FROM (SELECT period, t, sum(b) AS k FROM excp GROUP BY ALL) WHERE (period + 1) * 5 <= (SELECT max(t) + 1 FROM panel) GROUP BY period)"))
def coordination_historical_test(spark, sf):
    """The last five days against all earlier five days, each with thresholds of its own."""
    spans = panel(spark, sf).withColumn("period", F.floor(F.col("t") / 5))
    return stat(C.historical_test(P.exceedances(spans, "s", 0.1, ("entity", "period")), 5))


@query(with_sql(f"SELECT CAST({STAT} AS DOUBLE) AS stat, n * r1 AS expected, ({STAT} - n * r1) / sqrt(n * (r1 - r2)) AS z FROM (SELECT (pow(sum(r), 2) - sum(r * r)) / 2 AS r1, (pow(sum(r * r), 2) - sum(pow(r, 4))) / 2 AS r2 FROM (SELECT entity, avg(b) AS r FROM exc GROUP BY entity)), (SELECT count(DISTINCT t) AS n FROM exc)", PANEL, B))
def coordination_naive_test(spark, sf):
    return P.coordination_naive_test(exceeded(spark, sf)).withColumn("stat", F.col("stat").cast("double"))


@query(with_sql("SELECT entity, exp(sum(ln(e))) AS product FROM evals GROUP BY entity", PANEL, RESIDUAL, LAGGED, EVAL))
def evalue_product(spark, sf):
    return P.evalue_product(evals(spark, sf))


@query(with_sql("SELECT entity, product FROM (SELECT *, max(CASE WHEN product >= n / (0.9 * k) THEN k END) OVER () AS best FROM (SELECT *, row_number() OVER (ORDER BY product DESC) AS k, count(*) OVER () AS n FROM (SELECT entity, 1000 * exp(sum(ln(e))) AS product FROM evals GROUP BY entity))) WHERE k <= best", PANEL, RESIDUAL, LAGGED, EVAL))
def ebh_reject(spark, sf):
    return P.ebh_reject(P.evalue_product(evals(spark, sf)).withColumn("product", 1000 * F.col("product")), "product", 0.9)


def sums_sql(source: str, column: str) -> str:
    one = "SELECT entity, {s} AS scale, t, total FROM (SELECT entity, t, sum({c}) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) AS total, row_number() OVER (PARTITION BY entity ORDER BY t) AS i FROM {f}) WHERE i >= {s} AND (i - {s}) % {q} = 0"
    return "sums AS (" + " UNION ALL ".join(one.format(s=s, b=s - 1, q=max(s // 4, 1), c=column, f=source) for s in (4, 8, 16)) + ")"


@query(with_sql("SELECT entity, scale, t, total FROM sums", PANEL, sums_sql("panel", "s")))
def window_sums_multiscale(spark, sf):
    return P.window_sums(panel(spark, sf), "s", [4, 8, 16])


@query(with_sql("SELECT entity, max(CASE WHEN sd > 0 THEN (total - mean) / (sd * sqrt(1 + 1 / n)) END) AS score FROM (SELECT *, sqrt(greatest((sq - n * mean * mean) / (n - 1), 0)) AS sd FROM (SELECT *, (sum(total) OVER w - total) / n AS mean FROM (SELECT *, (count(*) OVER w - 1)::DOUBLE AS n, sum(total * total) OVER w - total * total AS sq FROM sums WINDOW w AS (PARTITION BY scale, t)) WINDOW w AS (PARTITION BY scale, t))) GROUP BY entity", PANEL, sums_sql("panel", "s")))
def peer_studentized_scan(spark, sf):
    return P.peer_studentized(P.window_sums(panel(spark, sf), "s", [4, 8, 16]))


HURST = "hurst AS (SELECT entity, least(greatest(regr_slope(ln(v), ln(m)) / 2, 0.5), 0.99) AS hurst FROM (SELECT entity, m, var_samp(s) AS v FROM (SELECT entity, m, t // m AS b, sum(s) AS s FROM panel, (SELECT unnest([1, 2, 3, 5]) AS m) GROUP BY ALL) GROUP BY entity, m) WHERE v > 0 GROUP BY entity)"


@query(with_sql("SELECT entity, hurst FROM hurst", PANEL, HURST))
def variance_time_hurst(spark, sf):
    return P.variance_time_hurst(panel(spark, sf), "s", [1, 2, 3, 5])


OWN = ["cen AS (SELECT p.entity, t, s - m AS x, v FROM panel p JOIN (SELECT entity, avg(s) AS m, var_samp(s) AS v FROM panel GROUP BY entity) USING (entity))", sums_sql("cen", "x"), HURST,
       "own AS (SELECT entity, max(total / (sqrt(v) * pow(scale, hurst))) AS score FROM sums JOIN (SELECT DISTINCT entity, v FROM cen) USING (entity) JOIN hurst USING (entity) WHERE v > 0 GROUP BY entity)"]


def own(spark, sf):
    return P.own_history_scan(panel(spark, sf), "s", [4, 8, 16], [1, 2, 3, 5])


@query(with_sql("SELECT entity, score FROM own", PANEL, *OWN))
def own_history_scan(spark, sf):
    return own(spark, sf)


@query(with_sql("SELECT quantile_cont(score, 0.95) AS threshold, avg(CAST(score > 2.0 AS INTEGER)) AS above_nominal FROM own", PANEL, *OWN))
def threshold_matched_fa(spark, sf):
    return P.threshold_matched(own(spark, sf), 0.05, 2.0)


@query(with_sql("SELECT entity, t, path, min(t) FILTER (path >= 60) OVER (PARTITION BY entity) AS first_alarm FROM (SELECT entity, t, c - least(0, min(c) OVER w) AS path FROM (SELECT entity, t, sum(residual - 5) OVER w AS c FROM residuals WINDOW w AS (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING))", PANEL, RESIDUAL))
def cusum_path(spark, sf):
    return P.cusum_path(residuals(spark, sf), "residual", 5.0, 60.0)


def days(spark, sf) -> int:
    """Length of the panel."""
    return panel(spark, sf).agg(F.max("t")).first()[0] + 1


@query(with_sql("SELECT entity, round(list_reduce(list_prepend(0.0::DOUBLE, list(residual ORDER BY t)), lambda a, x: 0.8 * a + 0.2 * x), 6) AS last FROM residuals GROUP BY entity", PANEL, RESIDUAL))
def ewma_last(spark, sf):
    return P.ewma_last(residuals(spark, sf), "residual", 0.2, days(spark, sf)).withColumn("last", F.round("last", 6))


WATCHED = """fitted AS (SELECT entity, avg(residual) AS mean, stddev_pop(residual) AS sd FROM residuals WHERE t < 10 GROUP BY entity),
watch AS (SELECT entity, 9 AS t, mean, sd, 0.0::DOUBLE AS e FROM fitted UNION ALL
 SELECT w.entity, r.t, 0.98 * w.mean + 0.02 * r.residual, w.sd, 0.8 * w.e + 0.2 * (r.residual - w.mean) / w.sd FROM watch w JOIN residuals r ON r.entity = w.entity AND r.t = w.t + 1)"""


@query(recursive("SELECT entity, t, round(CASE WHEN sd > 0 THEN e / sqrt(0.2 / 1.8) END, 6) AS path FROM watch WHERE t >= 10", PANEL, RESIDUAL, WATCHED))
def ewma_path(spark, sf):
    return P.ewma_path(residuals(spark, sf), "residual", 10, days(spark, sf), 0.2, 0.02).withColumn("path", F.round("path", 6))
