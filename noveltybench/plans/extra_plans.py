"""Queries: stateful references, drift bounds, target-only sets, packages and further resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noveltybench.functions.sampling import md5_order
from noveltybench.operators import metrics as M
from noveltybench.operators import packages as N
from noveltybench.operators import splits as S
from noveltybench.operators import stateful as Z
from noveltybench.operators import verify as V
from noveltybench.plans.base import PLACED, SEED, SPLIT_GAP, balance_sql, kept, query, windowed, with_sql
from noveltybench.plans.metric_plans import CUBE, draws_sql, mid, result_cube
from noveltybench.plans.panel_plans import PANEL, RESIDUAL, U, recursive, residuals
from noveltybench.plans.score_plans import VEC, vectors
from noveltybench.plans.window_plans import HEAD_TAIL, NOVEL, classes, placed, windows


SERIES = f"series AS (SELECT entity, list(residual ORDER BY t) AS xs, list({U} ORDER BY t) AS us, list(t ORDER BY t) AS ts FROM residuals GROUP BY entity)"


POWER, MIXTURE = "0.5 * pow(greatest({p}, 1e-12), -0.5)", "(1 - {q} + {q} * ln({q})) / ({q} * ln({q}) * ln({q}))"


def folded_sql(admits: str, reference: str, e: str = POWER, stride: int = 1, anchor: str = "") -> str:
    """CTE ``walk``: series folded step by step; i counts the steps done and lo + 1 .. hi is the lagged span.

    ``ok`` and ``pool`` are the usable steps and the standing pool, ``admits`` the value of ok after a step; ``anchor`` is
    the slice of xs that is frozen as a second reference.
    """

    def evalue(p: str) -> str:
        return e.format(p=p, q=f"least(greatest({p}, 1e-12), 1 - 1e-12)")

    second = f"greatest(ma, 1.0) * {evalue('pa')}" if anchor else "1.0"
    frozen = f"(len(list_filter(xs[{anchor}], lambda v: v > xs[i + 1])) + (us[i + 1] * 65536) % 1) / (len(xs[{anchor}]) + 1)" if anchor else "1.0"
    return f"""walk AS (SELECT entity, xs, us, ts, 10 AS i, 1.0::DOUBLE AS m, 1.0::DOUBLE AS ma, list_transform(range(0, 10), lambda k: TRUE) AS ok, xs[1:10] AS pool, range(1, 11) AS held, 0.0::DOUBLE AS p, 1.0::DOUBLE AS shown, FALSE AS hit FROM series WHERE len(xs) >= 10 UNION ALL
 SELECT entity, xs, us, ts, i + 1, CASE WHEN NOT due THEN m WHEN hit1 THEN 1.0 ELSE m1 END, CASE WHEN NOT due THEN ma WHEN hit1 THEN 1.0 ELSE ma1 END, {admits}, CASE WHEN due THEN pool1 ELSE pool END, CASE WHEN due THEN held1 ELSE held END, p1, m1, due AND hit1 FROM (
 SELECT *, (i - 10) % {stride} = 0 AS due, m1 >= 4 OR ma1 >= 4 AS hit1 FROM (
 SELECT *, greatest(m, 1.0) * {evalue('p1')} AS m1, {second} AS ma1 FROM (
 SELECT *, (len(list_filter(pool1, lambda v: v > xs[i + 1])) + us[i + 1]) / (len(pool1) + 1) AS p1, {frozen} AS pa FROM (
 SELECT *, list_transform(held1, lambda k: xs[k]) AS pool1 FROM (
 SELECT *, {reference} AS held1 FROM (
 SELECT *, list_filter(span, lambda k: ok[k]) AS usable FROM (
 SELECT *, range(greatest(i - 9, 0) + 1, greatest(i - 1, 0) + 1) AS span FROM walk WHERE i < len(xs)))))))))"""


GATE = ("list_append(ok, CASE WHEN due THEN m1 < 2 ELSE ok[len(ok)] END)", "CASE WHEN len(usable) >= 4 THEN usable ELSE span END")
GATE_WALK = folded_sql(*GATE)


@query(recursive("SELECT entity, ts[i] AS t, p, round(shown, 9) AS m, hit AS alarm FROM walk WHERE i > 10", PANEL, RESIDUAL, SERIES, GATE_WALK))
def gated_reference_alarms(spark, sf):
    found = Z.gated_reference(residuals(spark, sf), "residual", Z.Gated(10, 8, 1, 4.0, 4, gate=2.0))
    return found.withColumn("m", F.round("m", 9))


@query(recursive("SELECT entity, ts[i] AS t, p, round(shown, 9) AS m, hit AS alarm FROM walk WHERE i > 10 AND (i - 11) % 2 = 0", PANEL, RESIDUAL, SERIES, folded_sql(*GATE, MIXTURE, 2)))
def gated_reference_stride(spark, sf):
    """Every second day is tested, by the mixture calibrator."""
    found = Z.gated_reference(residuals(spark, sf), "residual", Z.Gated(10, 8, 1, 4.0, 4, stride=2, mixture=True, gate=2.0))
    return found.withColumn("m", F.round("m", 9))


#: ok covers all steps here: an alarm closes three steps before it and two after it, also those still to come.
POOL_RULE = (
    "CASE WHEN due AND hit1 THEN list_transform(range(1, len(xs) + 1), lambda k: coalesce(ok[k], TRUE) AND NOT (k >= i + 1 - 3 AND k <= i + 1 + 2)) ELSE ok END",
    "CASE WHEN len(usable) >= 4 THEN usable ELSE held END",
)


def pool_sql(*rule) -> list[str]:
    walk = folded_sql(*POOL_RULE, *rule).replace("list_transform(range(0, 10), lambda k: TRUE) AS ok", "list_transform(xs, lambda x: TRUE) AS ok")
    return [PANEL, RESIDUAL, SERIES, walk,
            "final AS (SELECT entity, arg_max(ok, i) AS ok, max(len(xs)) AS n, list(i) FILTER (hit) AS hits FROM walk GROUP BY entity)",
            "used AS (SELECT DISTINCT entity, unnest(held) AS k FROM walk WHERE i > 10)",
            """pools AS (SELECT f.entity, s.ts[g.k] AS t, coalesce(list_contains(f.hits, g.k), FALSE) AS alarm, u.k IS NOT NULL AS admitted, f.ok[g.k] AS vetted, f.ok[g.k] AND g.k > n - 9 AND g.k <= n - 1 AS in_final_pool
 FROM final f JOIN series s USING (entity) JOIN (SELECT entity, unnest(range(1, len(xs) + 1)) AS k FROM series) g ON g.entity = f.entity LEFT JOIN used u ON u.entity = f.entity AND u.k = g.k)"""]


POOL = pool_sql()


def pools(spark, sf):
    return Z.quarantined_pool(residuals(spark, sf), "residual", Z.Quarantined(10, 8, 1, 4.0, 4, purge=3, quarantine=2))


@query(recursive("SELECT * FROM pools", *POOL))
def purge_quarantine_pool(spark, sf):
    return pools(spark, sf)


@query(recursive("SELECT * FROM pools", *pool_sql(MIXTURE, 2, "3:8")))
def purge_quarantine_anchor(spark, sf):
    """Every second day is tested by the mixture calibrator, against the pool and against days 3 to 8 of the warm-up, frozen."""
    rule = Z.Quarantined(10, 8, 1, 4.0, 4, stride=2, mixture=True, purge=3, quarantine=2, anchor=(2, 8))
    return Z.quarantined_pool(residuals(spark, sf), "residual", rule)


@query(recursive("SELECT p.entity, coalesce(avg(CASE WHEN in_final_pool THEN CAST(t >= t0 AS INTEGER) END), 0.0) AS share, count(*) FILTER (admitted AND t >= t0) AS ever_admitted FROM pools p JOIN (SELECT entity, t AS t0 FROM residuals QUALIFY row_number() OVER (PARTITION BY entity ORDER BY residual DESC, t DESC) = 1) a USING (entity) GROUP BY p.entity", *POOL))
def contamination_fraction(spark, sf):
    """An entity's day of highest residual counts as the start of its attack."""
    t0 = residuals(spark, sf).groupBy("entity").agg(F.max_by("t", F.struct("residual", "t")).alias("t0"))
    return Z.contamination(pools(spark, sf), t0)


GATED = """walk AS (SELECT vec_id, x, 0 AS i, 0.0::DOUBLE AS h, 0.0::DOUBLE AS e FROM vec UNION ALL SELECT vec_id, x, i + 1, h1, e + 0.3 * exp(-abs(h1 - e) / 0.2) * (h1 - e) - 0.05 * e FROM (SELECT *, h + 0.4 * (x[i + 1] - h) AS h1 FROM walk WHERE i < 64))"""


def gated(spark, sf):
    states = Z.stress_gated_states(F.col("x"), 0.4, 0.3, 0.2, 0.05)
    return vectors(spark, sf).select("vec_id", F.posexplode(states).alias("i", "s")).select("vec_id", (F.col("i") + 1).alias("step"), F.col("s.stress").alias("stress"), F.col("s.moved").alias("moved"), F.col("s.level").alias("level"))


@query("WITH RECURSIVE " + VEC + ", " + GATED + " SELECT vec_id, round(avg(abs(h - e)), 9) AS stress FROM walk WHERE i > 0 GROUP BY vec_id")
def stress_gated_recurrence(spark, sf):
    return gated(spark, sf).groupBy("vec_id").agg(F.round(F.avg("stress"), 9).alias("stress"))


BOUND = "(0.3 * 0.2 / exp(1) / 0.05) * (1 - pow(0.95, i))"


@query("WITH RECURSIVE " + VEC + ", " + GATED + f" SELECT vec_id, round(max(abs(e)), 9) AS moved, round(min(least(1.0, {BOUND} / greatest(abs(e), 1e-12))), 9) AS absorbed, count(*) FILTER (abs(e) > {BOUND} + 1e-12) AS violations FROM walk WHERE i > 0 GROUP BY vec_id")
def drift_bound_audit(spark, sf):
    bound = Z.drift_bound(0.3, 0.2, 0.05, F.col("step"))
    return gated(spark, sf).groupBy("vec_id").agg(F.round(F.max("moved"), 9).alias("moved"), F.round(F.min(F.least(F.lit(1.0), bound / F.greatest("moved", F.lit(1e-12)))), 9).alias("absorbed"), F.count_if(F.col("moved") > bound + 1e-12).alias("violations"))


@query("WITH RECURSIVE " + VEC + ", " + GATED + f" SELECT vec_id, count(*) FILTER (abs(h - e) < greatest(0, abs(h) - {BOUND}) - 1e-12) AS violations, count(*) AS steps FROM walk WHERE i > 0 GROUP BY vec_id")
def residual_stress_audit(spark, sf):
    """|h - E| is at least |h| less the drift bound at every step."""
    bound = Z.drift_bound(0.3, 0.2, 0.05, F.col("step"))
    least = F.greatest(F.lit(0.0), F.col("level") - bound)
    return gated(spark, sf).groupBy("vec_id").agg(F.count_if(F.col("stress") < least - 1e-12).alias("violations"), F.count(F.lit(1)).alias("steps"))


# ---- target-only sets: anchors from the first four groups, tests from all others ------------------------------

TARGET = """pool AS (SELECT window_id, grp, row_number() OVER (ORDER BY md5(window_id || ':17'), window_id) AS place FROM win WHERE grp < 4 AND y_bin = 0),
others AS (SELECT * FROM win WHERE grp >= 4), avail AS (SELECT y_cls AS code, count(*) AS n FROM others WHERE y_bin = 1 GROUP BY y_cls),
numbered_cls AS (SELECT code, n, row_number() OVER (ORDER BY n, code) AS i, count(*) OVER () AS m FROM avail),
fill AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS quota, CAST(0 AS INTEGER) AS code, CAST((SELECT count(*) FROM others WHERE y_bin = 0) // 5 AS BIGINT) AS rest UNION ALL
 SELECT c.i, least(c.n, f.rest // (c.m - c.i + 1)), c.code, f.rest - least(c.n, f.rest // (c.m - c.i + 1)) FROM fill f JOIN numbered_cls c ON c.i = f.i + 1),
tested AS (SELECT window_id, grp, y_bin FROM others WHERE y_bin = 0 UNION ALL SELECT window_id, grp, y_bin FROM (SELECT o.*, quota, row_number() OVER (PARTITION BY y_cls ORDER BY md5(window_id || ':17'), window_id) AS place FROM others o JOIN fill ON code = y_cls AND fill.i > 0 WHERE y_bin = 1) WHERE place <= quota),
target AS (SELECT 'anchor_500' AS set_name, window_id, grp, 0 AS y_bin FROM pool WHERE place <= 500 UNION ALL SELECT 'anchor_100', window_id, grp, 0 FROM pool WHERE place <= 100 UNION ALL SELECT 'test', window_id, grp, y_bin FROM tested)"""


def recursive_windowed(select: str, *parts: str) -> str:
    return windowed(select, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


@kept("target_only")
def target_sets(spark, sf):
    w = windows(spark, sf)
    pool = w.where("grp < 4 and y_bin = 0").orderBy(md5_order("window_id", SEED), "window_id")
    anchors = [pool.limit(n).select(F.lit(f"anchor_{n}").alias("set_name"), "window_id", "grp", "y_bin") for n in (500, 100)]
    others = w.where("grp >= 4")
    total = others.agg(F.floor(F.count_if(F.col("y_bin") == 0) / 5).alias("total"))
    avail = others.where("y_bin = 1").groupBy(F.col("y_cls").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    quotas = Z.water_fill(avail.crossJoin(F.broadcast(total)), F.col("total"))
    ranked = others.where("y_bin = 1").withColumn("place", F.row_number().over(Window.partitionBy("y_cls").orderBy(md5_order("window_id", SEED), "window_id")))
    attack = ranked.join(F.broadcast(quotas), F.col("y_cls") == F.col("code")).where("place <= quota")
    test = others.where("y_bin = 0").select("window_id", "grp", "y_bin").unionByName(attack.select("window_id", "grp", "y_bin"))
    return anchors[0].unionByName(anchors[1]).unionByName(test.select(F.lit("test").alias("set_name"), "window_id", "grp", "y_bin"))


@query(recursive_windowed("SELECT set_name, window_id, y_bin FROM target", TARGET))
def target_only_sets(spark, sf):
    return target_sets(spark, sf).select("set_name", "window_id", "y_bin")


@query(recursive_windowed("""SELECT check_name, CAST(v AS BIGINT) AS violations, v = 0 AS ok FROM (
 SELECT 'groups_disjoint' AS check_name, count(*) AS v FROM (SELECT grp FROM target GROUP BY grp HAVING count(DISTINCT set_name = 'test') > 1)
 UNION ALL SELECT 'anchors_nested', count(*) FROM (SELECT window_id FROM target WHERE set_name = 'anchor_100' AND window_id NOT IN (SELECT window_id FROM target WHERE set_name = 'anchor_500'))
 UNION ALL SELECT 'anchors_benign', count(*) FROM target WHERE set_name <> 'test' AND y_bin = 1
 UNION ALL SELECT 'no_window_twice', count(*) FROM (SELECT set_name, window_id FROM target GROUP BY ALL HAVING count(*) > 1))""", TARGET))
def verify_target_only(spark, sf):
    t = target_sets(spark, sf)
    small, large = (t.where(F.col("set_name") == f"anchor_{n}").select("window_id") for n in (100, 500))
    return V.together(
        V.disjoint(t.withColumn("side", F.when(F.col("set_name") == "test", "test").otherwise("anchor")), "grp", "side", "groups_disjoint"),
        V.check(small.join(large, "window_id", "left_anti"), "anchors_nested"),
        V.check(t.where("set_name <> 'test' and y_bin = 1"), "anchors_benign"),
        V.check(t.groupBy("set_name", "window_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "no_window_twice"),
    )


# ---- novelty package: head trains, tail validates, the first benign test windows anchor, novel classes test ---------

#: The fixture has a few hundred test windows, so its anchor sets are smaller than the operator's 100 and 500.
ANCHORS = (20, 60)
PACKAGE = [SPLIT_GAP, PLACED, HEAD_TAIL, NOVEL, "masked AS (SELECT CAST(coalesce(sum(1 << code), 0) AS BIGINT) AS m FROM novel)",
           "clean AS (SELECT p.window_id, p.grp, p.y_bin, h.side FROM placed p JOIN ht h ON h.grp = p.grp, masked WHERE p.split = 'train' AND (class_mask & m) = 0)",
           "head AS (SELECT * FROM clean WHERE side = 'head')", "tail AS (SELECT * FROM clean WHERE side = 'tail')", balance_sql("head", "trained", 1, 14_000), balance_sql("tail", "validated", 5, 3_000),
           "tested AS (SELECT * FROM placed WHERE split = 'test')", "anchors AS (SELECT window_id, grp, row_number() OVER (ORDER BY grp, k) AS place FROM tested WHERE y_bin = 0 QUALIFY place <= 60)",
           "pool AS (SELECT * FROM tested WHERE grp NOT IN (SELECT grp FROM anchors))",
           """package AS (SELECT 'train' AS set_name, window_id, grp, y_bin FROM trained UNION ALL SELECT 'val', window_id, grp, y_bin FROM validated UNION ALL SELECT 'anchor_20', window_id, grp, 0 FROM anchors WHERE place <= 20
 UNION ALL SELECT 'anchor_60', window_id, grp, 0 FROM anchors UNION ALL (SELECT 'test_benign', window_id, grp, y_bin FROM pool WHERE y_bin = 0 ORDER BY md5(window_id || ':17'), window_id LIMIT 2500)
 UNION ALL SELECT 'test/' || cls, window_id, grp, y_bin FROM (SELECT p.*, c.cls, row_number() OVER (PARTITION BY y_cls ORDER BY md5(window_id || ':17'), window_id) AS place FROM pool p JOIN novel n ON n.code = p.y_cls JOIN codes c ON c.code = n.code) WHERE place <= 500)"""]


@kept("novel_classes")
def novel_classes(spark, sf):
    found = S.nn_class_discovery(placed(spark, sf, True), classes(spark, sf, True)).select("code")
    return found.join(classes(spark, sf, True), "code")


@kept("package")
def package(spark, sf):
    return N.novelty_package(placed(spark, sf, True), novel_classes(spark, sf), SEED, ANCHORS)


@query(windowed("SELECT set_name, window_id, y_bin FROM package", *PACKAGE, late=True))
def novelty_package(spark, sf):
    return package(spark, sf).select("set_name", "window_id", "y_bin")


@query(windowed("""SELECT check_name, CAST(v AS BIGINT) AS violations, v = 0 AS ok FROM (
 SELECT 'learned_in_train' AS check_name, count(*) AS v FROM full_rows WHERE set_name IN ('train', 'val') AND split <> 'train'
 UNION ALL SELECT 'head_and_tail_apart', count(DISTINCT grp) FROM full_rows WHERE set_name = 'train' AND grp IN (SELECT grp FROM full_rows WHERE set_name = 'val')
 UNION ALL SELECT 'tail_after_head', count(*) FROM full_rows WHERE set_name = 'val' AND grp <= (SELECT max(grp) FROM full_rows WHERE set_name = 'train')
 UNION ALL SELECT 'no_novel_flow_learned', count(*) FROM full_rows, masked WHERE set_name IN ('train', 'val') AND (class_mask & m) <> 0
 UNION ALL SELECT 'val_has_both_labels', 2 - count(DISTINCT y_bin) FROM full_rows WHERE set_name = 'val'
 UNION ALL SELECT 'tested_in_test', count(*) FROM full_rows WHERE set_name LIKE 'test%' AND split <> 'test'
 UNION ALL SELECT 'test_without_anchor_groups', count(*) FROM full_rows WHERE set_name LIKE 'test%' AND grp IN (SELECT grp FROM full_rows WHERE set_name LIKE 'anchor%')
 UNION ALL SELECT 'anchors_benign', count(*) FROM full_rows WHERE set_name LIKE 'anchor%' AND y_bin <> 0
 UNION ALL SELECT 'anchors_nested', count(*) FROM full_rows WHERE set_name = 'anchor_20' AND window_id NOT IN (SELECT window_id FROM full_rows WHERE set_name = 'anchor_60')
 UNION ALL SELECT 'test_benign_is_benign', count(*) FROM full_rows WHERE set_name = 'test_benign' AND y_bin <> 0
 UNION ALL SELECT 'class_sets_hold_their_class', count(*) FROM full_rows f LEFT JOIN (SELECT * FROM codes JOIN novel USING (code)) c ON 'test/' || c.cls = f.set_name WHERE set_name LIKE 'test/%' AND c.code IS DISTINCT FROM f.y_cls
 UNION ALL SELECT 'class_sets_not_empty', count(*) FROM novel n JOIN codes c USING (code) WHERE 'test/' || c.cls NOT IN (SELECT set_name FROM full_rows)
 UNION ALL SELECT 'novel_class_not_learned', count(*) FROM full_rows WHERE set_name IN ('train', 'val') AND y_cls IN (SELECT code FROM novel)
 UNION ALL SELECT 'no_window_twice', count(*) FROM (SELECT set_name, window_id FROM package GROUP BY ALL HAVING count(*) > 1))""", *PACKAGE, "full_rows AS (SELECT m.set_name, p.* FROM package m JOIN placed p USING (window_id))", late=True))
def verify_package(spark, sf):
    return N.verify_package(package(spark, sf), placed(spark, sf, True), novel_classes(spark, sf))


# ---- resampled rank correlations of the cube's points ------------------------------------------------------------

POINTS = "points AS (SELECT detector || ':' || cls AS unit, round(avg(auc) FILTER (seed = 0), 9) AS a, round(avg(auc) FILTER (seed > 0), 9) AS b, round(avg(auc) FILTER (seed = 1), 9) AS c FROM cube0 GROUP BY detector, cls)"
COPIES = "copies AS (SELECT rep, a, b, c FROM points JOIN dr USING (unit), LATERAL (SELECT unnest(range(0, times))))"


def points(spark, sf):
    def mean(when):
        return F.round(F.avg(F.when(when, F.col("auc"))), 9)

    seed = F.col("seed")
    return result_cube(spark, sf).groupBy("detector", "cls").agg(mean(seed == 0).alias("a"), mean(seed > 0).alias("b"), mean(seed == 1).alias("c")).select(F.concat_ws(":", "detector", "cls").alias("unit"), "a", "b", "c")


def copies(spark, sf, seed):
    p = points(spark, sf)
    drawn = p.join(M.draws(p, "unit", 100, seed), "unit")
    return drawn.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("rep", "a", "b", "c")


def rho_sql(y: str) -> str:
    return f"(SELECT rep, corr(rx, ry) AS rho FROM (SELECT rep, {mid('a', 'rep')} AS rx, {mid(y, 'rep')} AS ry FROM copies) GROUP BY rep)"


@query(with_sql(f"SELECT count(rho) AS reps, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM {rho_sql('b')}", CUBE, POINTS, draws_sql("points", "unit", 100, 21, "dr"), COPIES))
def spearman_bootstrap(spark, sf):
    return M.percentile_interval(M.spearman(copies(spark, sf, 21), ["rep"], "a", "b", 1), [], "rho")


@query(with_sql(f"SELECT count(d) AS reps, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM (SELECT x.rho - y.rho AS d FROM {rho_sql('b')} x JOIN {rho_sql('c')} y USING (rep))", CUBE, POINTS, draws_sql("points", "unit", 100, 22, "dr"), COPIES))
def bootstrap_paired_rho_diff(spark, sf):
    c = copies(spark, sf, 22)
    one = M.spearman(c, ["rep"], "a", "b", 1).withColumnRenamed("rho", "r1")
    both = one.join(M.spearman(c, ["rep"], "a", "c", 1).withColumnRenamed("rho", "r2"), "rep")
    return M.percentile_interval(both.withColumn("d", F.col("r1") - F.col("r2")), [], "d")


@query(with_sql(f"SELECT 'b' AS predictor, corr(rx, ry) AS rho FROM (SELECT {mid('a')} AS rx, {mid('b')} AS ry FROM points) UNION ALL SELECT 'c', corr(rx, ry) FROM (SELECT {mid('a')} AS rx, {mid('c')} AS ry FROM points)", CUBE, POINTS))
def predictor_correlations(spark, sf):
    long = points(spark, sf).unpivot(["unit", "a"], ["b", "c"], "predictor", "value")
    return M.spearman(long, ["predictor"], "a", "value", 1)


SENS = " UNION ALL ".join(f"SELECT {s} AS rng, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM (SELECT rep, sum(times * m) / sum(times) AS mean FROM (SELECT cls, avg(auc) AS m FROM quad GROUP BY cls) JOIN d{s} USING (cls) GROUP BY rep)" for s in range(31, 35))


@query(with_sql(f"SELECT min(low) AS lowest, max(low) AS highest_low, avg(CAST(low > 0.5 AS INTEGER)) AS share_above_half FROM ({SENS})", CUBE, "quad AS (SELECT * FROM cube0 WHERE detector = 'quad')", *[draws_sql("quad", "cls", 50, s, f"d{s}") for s in range(31, 35)]))
def bootstrap_rng_sensitivity(spark, sf):
    """Range of the lower bound over four draws of the resampler."""
    m = result_cube(spark, sf).where("detector = 'quad'").groupBy("cls").agg(F.avg("auc").alias("m"))
    parts = None
    for s in range(31, 35):
        d = m.join(M.draws(m, "cls", 50, s), "cls").groupBy("rep").agg((F.sum(F.col("times") * F.col("m")) / F.sum("times")).alias("mean"))
        one = M.percentile_interval(d, [], "mean")
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.min("low").alias("lowest"), F.max("low").alias("highest_low"), F.avg((F.col("low") > 0.5).cast("int")).alias("share_above_half"))
