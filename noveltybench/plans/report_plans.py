"""Queries: reports over run tables, provenance checks, refitted cleaners, finished archives and identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from noveltybench.operators import audit as A
from noveltybench.operators import clean as K
from noveltybench.operators import cube as C
from noveltybench.operators import identify as I
from noveltybench.operators import metrics as M
from noveltybench.operators import panel as P
from noveltybench.operators import ranks as R
from noveltybench.operators import splits as S
from noveltybench.operators import verify as V
from noveltybench.operators import windows as W
from noveltybench.plans.base import SEED, SIZE, SPLIT_RANDOM, STRIDE, kept, query, table, windowed, with_sql
from noveltybench.plans.clean_plans import COLUMNS, FEATURES, HEAVY, KEPT, features, stats_sql
from noveltybench.plans.extra_plans import POINTS, points
from noveltybench.plans.metric_plans import CUBE, F1, WIDE, draws_sql, mid, result_cube, wide
from noveltybench.plans.panel_plans import LAGGED, OWN, PANEL, RESIDUAL, lagged, panel
from noveltybench.plans.window_plans import SETS, numbered, windows
from noveltybench.sources import tables as T

# ---- panels ------------------------------------------------------------------------------------------------------


def quantile_sql(p: str) -> str:
    """The normal quantile of ``normal_quantile`` as SQL."""

    def horner(coefficients: tuple[float, ...], x: str) -> str:
        out = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    def tail(q: str) -> str:
        x = f"sqrt(-2 * ln({q}))"
        return f"{horner(R.QUANTILE_C, x)} / ({horner(R.QUANTILE_D, x)} * {x} + 1)"

    x = f"({p} - 0.5)"
    x2 = f"({x} * {x})"
    return f"CASE WHEN {p} < {R.QUANTILE_LOW} THEN {tail(p)} WHEN {p} > 1 - {R.QUANTILE_LOW} THEN -({tail(f'(1 - {p})')}) ELSE {horner(R.QUANTILE_A, x2)} * {x} / ({horner(R.QUANTILE_B, x2)} * {x2} + 1) END"


@query(with_sql(f"SELECT entity, t, exp(z - 0.5) AS e, 0.3 * exp(z - 0.5) + 0.7 AS hedged FROM (SELECT entity, t, {quantile_sql('q')} AS z FROM (SELECT entity, t, 1 - least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM lagged))", PANEL, RESIDUAL, LAGGED))
def calibrate_roc_slope(spark, sf):
    return lagged(spark, sf).select("entity", "t", P.roc_slope_e(F.col("p"), 1.0).alias("e"), P.roc_slope_e(F.col("p"), 1.0, 0.3).alias("hedged"))


MET = "met AS (SELECT entity, total, sqrt(v) * pow(scale, hurst) AS spread, greatest(t + 1 - scale, 10) AS a, least(t + 1, 15) AS b FROM sums JOIN (SELECT DISTINCT entity, v FROM cen) USING (entity) JOIN hurst USING (entity) WHERE v > 0)"


@query(with_sql("SELECT entity, min(greatest((2 * spread - total) / (b - a), 0)) AS step, min(greatest((2 * spread - total) / ((a - 9 + b - 10) * (b - a) / 2 / 5), 0)) AS ramp FROM met WHERE b > a GROUP BY entity", PANEL, *OWN[:3], MET))
def critical_amplitude(spark, sf):
    sums = P.own_history_sums(panel(spark, sf), "s", [4, 8, 16], [1, 2, 3, 5])
    return P.critical_amplitude(sums, 10, 5, 2.0)


# ---- identification: families are labels 0, 1 and 2, calibrated on every fourth vector ----------------------------

IDENTIFY = """vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
cal AS (SELECT label AS fam, vec_id, x FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM vec WHERE label < 3 AND vec_id % 4 = 0) WHERE place <= 100),
scored AS (SELECT fam, a.vec_id, list_avg(list_sort(list(list_distance(a.x, b.x)))[2:6]) AS score FROM cal a JOIN cal b USING (fam) GROUP BY fam, a.vec_id),
means AS (SELECT fam, list(m ORDER BY i) AS x FROM (SELECT fam, i, avg(x[i]) AS m FROM cal, (SELECT unnest(range(1, 65)) AS i) GROUP BY fam, i) GROUP BY fam),
usual AS (SELECT fam, list_grade_up(x, 'DESC')[1:4] AS u FROM means),
jac AS (SELECT fam, len(list_intersect(list_grade_up(x, 'DESC')[1:4], u)) / len(list_distinct(list_concat(list_grade_up(x, 'DESC')[1:4], u))) AS j FROM cal JOIN usual USING (fam)),
probe AS (SELECT vec_id, x, list_grade_up(x, 'DESC')[1:4] AS s FROM vec WHERE vec_id % 4 <> 0),
near AS (SELECT p.vec_id, c.fam, list_avg(list_sort(list(list_distance(p.x, c.x)))[1:5]) AS score FROM probe p, cal c GROUP BY p.vec_id, c.fam),
accepted AS (SELECT n.vec_id, n.fam, (1 + count(*) FILTER (c.score >= n.score)) / (count(*) + 1) > 0.1 AS ok FROM near n JOIN scored c USING (fam) GROUP BY n.vec_id, n.fam),
alike AS (SELECT p.vec_id, u.fam, (1 + count(*) FILTER (j.j <= len(list_intersect(p.s, u.u)) / len(list_distinct(list_concat(p.s, u.u))))) / (count(*) + 1) > 0.1 AS ok FROM probe p, usual u JOIN jac j USING (fam) GROUP BY p.vec_id, u.fam),
votes AS (SELECT a.vec_id, count(*) FILTER (a.ok) AS n, min(a.fam) FILTER (a.ok) AS f, count(*) FILTER (l.ok) AS m, min(l.fam) FILTER (l.ok) AS g FROM accepted a JOIN alike l USING (vec_id, fam) GROUP BY a.vec_id)"""


@query(with_sql("SELECT vec_id, CASE WHEN n = 1 THEN 'name:' || f WHEN n > 1 THEN 'ambiguous' WHEN m = 1 THEN 'variant:' || g WHEN m > 1 THEN 'ambiguous' ELSE 'unfamiliar' END AS decision FROM votes", IDENTIFY))
def identify_conformal_knn(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    known = I.calibration(v.where("label < 3 and vec_id % 4 = 0"), "label", "vec_id")
    return I.conformal_knn(v.where("vec_id % 4 <> 0"), known, "vec_id", "label", "x")


# ---- protocols ---------------------------------------------------------------------------------------------------

STRATA = "cells AS (SELECT split_part(unit, ':', 1) AS detector, unit, a, b FROM points)"
STRATA_DRAWS = """numbered AS (SELECT detector, unit, row_number() OVER (PARTITION BY detector ORDER BY unit) - 1 AS idx, count(*) OVER (PARTITION BY detector) AS n FROM cells),
drawn AS (SELECT rep, detector, CAST('0x' || substr(md5('23:' || rep || ':' || detector || ':' || idx), 1, 8) AS BIGINT) % n AS idx FROM numbered, (SELECT unnest(range(0, 100)) AS rep)),
copies AS (SELECT rep, c.detector, a, b FROM drawn d JOIN numbered n ON n.detector = d.detector AND n.idx = d.idx JOIN cells c ON c.unit = n.unit)"""
STRATA_RHO = f"rhos AS (SELECT rep, detector, CASE WHEN count(*) >= 3 AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS rho FROM (SELECT rep, detector, {mid('a', 'rep, detector')} AS rx, {mid('b', 'rep, detector')} AS ry FROM copies) GROUP BY rep, detector)"


@query(with_sql("SELECT count(*) AS reps, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM (SELECT rep, avg(rho) AS rho FROM rhos GROUP BY rep HAVING count(rho) = 4)", CUBE, POINTS, STRATA, STRATA_DRAWS, STRATA_RHO))
def bootstrap_stratified_rho(spark, sf):
    """Points are resampled within each detector; the detectors' rank correlations are averaged."""
    return M.percentile_interval(M.stratified_rho(stratified_copies(spark, sf), "detector", "a", "b"), [], "rho")


PAIRED = [CUBE, "even AS (SELECT * FROM cube0 WHERE cls % 2 = 0)", "odd AS (SELECT * FROM cube0 WHERE cls % 2 = 1)", draws_sql("even", "cls", 100, 24, "da"), draws_sql("odd", "cls", 100, 25, "db"), draws_sql("cube0", "seed", 100, 26, "ds"),
          *[f"side_{x} AS (SELECT rep, detector, sum(d.times * s.times * auc) / sum(d.times * s.times) AS {x} FROM cube0 JOIN d{x} d USING (cls) JOIN ds s USING (rep, seed) GROUP BY rep, detector)" for x in "ab"],
          "sides AS (SELECT * FROM side_a JOIN side_b USING (rep, detector))",
          f"reps AS (SELECT rep, avg(b - a) AS delta, corr(rx, ry) AS rho, arg_max(detector, a) = arg_max(detector, b) AS same FROM (SELECT *, {mid('a', 'rep')} AS rx, {mid('b', 'rep')} AS ry FROM sides) GROUP BY rep)"]


@kept("paired_replicates")
def paired_replicates(spark, sf):
    c = result_cube(spark, sf)
    return C.agreement_replicates(c, M.draws(c.where("cls % 2 = 0"), "cls", 100, 24), M.draws(c.where("cls % 2 = 1"), "cls", 100, 25), M.draws(c, "seed", 100, 26))


@kept("stratified_copies")
def stratified_copies(spark, sf):
    cells = points(spark, sf).select(F.split_part("unit", F.lit(":"), F.lit(1)).alias("detector"), "unit", "a", "b")
    drawn = cells.join(M.draws_within(cells, "detector", "unit", 100, 23), ["detector", "unit"])
    return drawn.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("rep", "detector", "a", "b")


@query(with_sql("SELECT count(*) AS reps, quantile_cont(delta, 0.025) AS delta_low, quantile_cont(delta, 0.975) AS delta_high, quantile_cont(rho, 0.025) AS rho_low, quantile_cont(rho, 0.975) AS rho_high, avg(CAST(same AS INTEGER)) AS p_same_winner FROM reps", *PAIRED))
def protocol_agreement_bootstrap(spark, sf):
    """Classes are drawn for each protocol (even and odd ones), seeds for both together."""
    replicates = paired_replicates(spark, sf)
    per = replicates.groupBy("rep").agg(F.avg(F.col("b") - F.col("a")).alias("delta"), (F.max_by("detector", "a") == F.max_by("detector", "b")).alias("same"))
    per = per.join(M.spearman(replicates, ["rep"], "a", "b", 1), "rep")
    ends = [F.percentile(v, q).alias(f"{v}_{name}") for v in ("delta", "rho") for q, name in ((0.025, "low"), (0.975, "high"))]
    return per.agg(F.count(F.lit(1)).alias("reps"), *ends, F.avg(F.col("same").cast("int")).alias("p_same_winner"))


CONFIGS = [CUBE, "pmc AS (SELECT seed, detector, avg(auc) FILTER (cls % 2 = 0) AS a, avg(auc) FILTER (cls % 2 = 1) AS b FROM cube0 GROUP BY seed, detector)",
           f"rhoc AS (SELECT seed, corr(rx, ry) AS rho FROM (SELECT seed, {mid('a', 'seed')} AS rx, {mid('b', 'seed')} AS ry FROM pmc) GROUP BY seed)",
           """agree AS (SELECT seed, avg(b - a) AS mean_delta, avg(abs(b - a)) AS mean_abs_delta, max(abs(b - a)) AS max_abs_delta, arg_max(detector, a) = arg_max(detector, b) AS same_winner, max(b) - arg_max(b, a) AS regret, count(*) FILTER ((a < 0.5) <> (b < 0.5)) AS side_flips FROM pmc GROUP BY seed)""",
           "disc AS (SELECT x.seed, count(*) FILTER ((x.a - y.a) * (x.b - y.b) < 0) AS discordant FROM pmc x JOIN pmc y ON x.seed = y.seed AND x.detector < y.detector GROUP BY x.seed)"]


@query(with_sql("""SELECT count(*) AS configurations, count(*) FILTER (mean_delta < 0) AS lower_under_b, count(*) FILTER (NOT same_winner) AS winner_flips, CAST(sum(side_flips) AS BIGINT) AS side_flips, CAST(sum(discordant) AS BIGINT) AS discordant,
 min(rho) AS rho_low, max(rho) AS rho_high, median(rho) AS rho_median, median(regret) AS regret_median, max(regret) AS regret_max, min(mean_abs_delta) AS mean_abs_delta_low, max(mean_abs_delta) AS mean_abs_delta_high, max(max_abs_delta) AS max_abs_delta
 FROM agree JOIN disc USING (seed) JOIN rhoc USING (seed)""", *CONFIGS))
def protocol_agreement_rollup(spark, sf):
    """Configurations are seeds."""
    c = result_cube(spark, sf).withColumn("protocol", F.when(F.col("cls") % 2 == 0, "even").otherwise("odd"))
    means = c.groupBy("seed", "detector").agg(*[F.avg(F.when(F.col("protocol") == p, F.col("auc"))).alias(x) for x, p in (("a", "even"), ("b", "odd"))])
    return C.agreement_rollup(C.protocol_agreement(means, ["seed"]).join(M.spearman(means, ["seed"], "a", "b", 1), "seed"))


# ---- dose response: three data sets by group, a dose mixes another coordinate into the score -----------------------

GAMMAS, VARIANTS = (0.0, 0.25, 0.5, 1.0), ((1.0, 0.1), (1.0, 0.2), (2.0, 0.1))
D_PRIME = "(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0)) / sqrt((var_samp(score) FILTER (y = 1) + var_samp(score) FILTER (y = 0)) / 2 + 1e-24)"


def runs_sql(source: str, keys: str, where: str) -> str:
    return f"""SELECT {keys}, {D_PRIME} AS d_prime, 100 * {F1} AS macro_f1 FROM (SELECT {keys}, y, score, (count(*) FILTER (score > 0 AND y = 1) OVER w)::DOUBLE AS tp, (count(*) FILTER (score > 0 AND y = 0) OVER w)::DOUBLE AS fp, (count(*) FILTER (score <= 0 AND y = 1) OVER w)::DOUBLE AS fn, (count(*) FILTER (score <= 0 AND y = 0) OVER w)::DOUBLE AS tn
 FROM {source} WHERE {where} WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys}, tp, fp, fn, tn"""


DOSES = [WIDE, "placed AS (SELECT *, grp % 3 AS dataset, (grp // 3) % 2 = 0 AS test FROM wide)",
         f"dosed AS (SELECT dataset, test, gamma, y, dim1 + gamma * dim2 AS score FROM placed, (SELECT unnest({list(GAMMAS)}) AS gamma))", f"sweep AS ({runs_sql('dosed', 'dataset, gamma', 'test')})",
         "varied AS (SELECT dataset, test, tau, kappa, y, dim1 + kappa * (quad - 1) / tau AS score FROM placed, (VALUES " + ", ".join(f"({t}::DOUBLE, {k}::DOUBLE)" for t, k in VARIANTS) + ") v(tau, kappa))",
         f"tested AS ({runs_sql('varied', 'dataset, tau, kappa', 'test')})", f"validated AS ({runs_sql('varied', 'dataset, tau, kappa', 'NOT test')})",
         "best AS (SELECT DISTINCT ON (dataset) t.* FROM tested t JOIN validated v USING (dataset, tau, kappa) ORDER BY dataset, round(v.macro_f1) DESC, tau, kappa)",
         f"rho AS (SELECT dataset, corr(rx, ry) AS rho FROM (SELECT dataset, {mid('gamma', 'dataset')} AS rx, {mid('d_prime', 'dataset')} AS ry FROM sweep) GROUP BY dataset)"]


def dosed_runs(rows, keys):
    """d' and macro F1 in per cent of scores above 0."""
    zero = rows.select(*keys).distinct().withColumn("threshold", F.lit(0.0))
    f1 = M.macro_f1(M.confusion(rows, zero, keys), keys)
    return M.d_prime(rows, keys).join(f1.withColumn("macro_f1", 100 * F.col("macro_f1")), keys)


@query(with_sql("SELECT dataset, rho, b.tau, b.kappa, b.d_prime / s.d_prime AS ratio, s.macro_f1 - b.macro_f1 AS f1_drop, coalesce(rho <= -0.8, FALSE) AS falls, b.d_prime >= 0.8 * s.d_prime AND s.macro_f1 - b.macro_f1 < 1 AS holds, coalesce(rho <= -0.8, FALSE) AND b.d_prime >= 0.8 * s.d_prime AND s.macro_f1 - b.macro_f1 < 1 AS both FROM rho JOIN best b USING (dataset) JOIN (SELECT * FROM sweep WHERE gamma = 0) s USING (dataset)", *DOSES))
def gate_dose_response(spark, sf):
    w = wide(spark, sf).withColumn("dataset", F.col("grp") % 3).withColumn("test", F.floor(F.col("grp") / 3) % 2 == 0)
    gammas = F.broadcast(spark.createDataFrame([(g,) for g in GAMMAS], "gamma double"))
    variants = F.broadcast(spark.createDataFrame(list(VARIANTS), "tau double, kappa double"))
    sweep = dosed_runs(w.where("test").crossJoin(gammas).withColumn("score", F.col("dim1") + F.col("gamma") * F.col("dim2")), ["dataset", "gamma"])
    varied = w.crossJoin(variants).withColumn("score", F.col("dim1") + F.col("kappa") * (F.col("quad") - 1) / F.col("tau"))
    keys = ["dataset", "tau", "kappa"]
    validated = dosed_runs(varied.where("not test"), keys).select(*keys, F.round("macro_f1").alias("validation"))
    return C.dose_response(sweep, dosed_runs(varied.where("test"), keys).join(validated, keys))


# ---- provenance and time of runs: orders stand for runs ------------------------------------------------------------


@query("""SELECT kind1 AS separate_hours, kind2 AS shared_hours, kind1 + kind2 AS total_hours FROM (SELECT coalesce(sum(o_totalprice), 0) / 3600 AS kind1 FROM orders WHERE o_orderstatus = 'O'),
 (SELECT coalesce(sum(s), 0) / 3600 AS kind2 FROM (SELECT max(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey, o_orderkey % 5))""")
def elapsed_rollup(spark, sf):
    """Open orders stand for separate runs, others for runs of a training shared by customer and seed."""
    o = table(spark, sf, "orders")
    return C.elapsed(o.select(F.when(F.col("o_orderstatus") == "O", "separate").otherwise("shared").alias("kind"), F.col("o_custkey").alias("eval_id"), (F.col("o_orderkey") % 5).alias("seed"), F.col("o_totalprice").alias("wall_seconds")))


@query("""SELECT o_orderpriority AS experiment, count(*) AS runs, count(DISTINCT o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0) AS commits, count(*) FILTER (o_orderpriority = '2-HIGH' AND o_orderkey % 89 = 0) AS unclean,
 count(DISTINCT o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0) = 1 AND count(*) FILTER (o_orderpriority = '2-HIGH' AND o_orderkey % 89 = 0) = 0 AS ok FROM orders GROUP BY 1""")
def verify_single_provenance(spark, sf):
    """Experiments are order priorities; one has runs of a second commit, another has runs from an unclean tree."""
    o = table(spark, sf, "orders")
    runs = o.select(
        F.col("o_orderpriority").alias("experiment"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 97 == 0), "b").otherwise("a").alias("code_commit"),
        ((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderkey") % 89 == 0)).alias("dirty"),
        F.lit(False).alias("smoke"),
    )
    return V.single_provenance(runs, "experiment")


DIGESTED = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
DIGEST = "CAST(sum(CAST('0x' || substr(md5(concat_ws('|', c_custkey, c_name, c_nationkey, c_mktsegment)), 1, 12) AS BIGINT)) AS VARCHAR) AS digest, CAST(count(*) AS VARCHAR) AS n"


@query(f"""WITH now AS (SELECT c_mktsegment AS artefact, {DIGEST} FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1),
old AS (SELECT c_mktsegment AS artefact, {DIGEST} FROM customer WHERE c_mktsegment <> 'MACHINERY' AND NOT (c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_custkey % 50 = 0) GROUP BY 1),
cells AS (SELECT coalesce(a.artefact, b.artefact) AS artefact, a.digest AS d1, b.digest AS d2, a.n AS n1, b.n AS n2 FROM old a FULL OUTER JOIN now b USING (artefact)),
long AS (SELECT artefact, 'digest' AS what, d1 AS a, d2 AS b FROM cells UNION ALL SELECT artefact, 'rows', n1, n2 FROM cells)
SELECT artefact, what, CASE WHEN a = b THEN TRUE WHEN artefact = 'BUILDING' THEN NULL ELSE FALSE END AS match FROM long""")
def verify_recorded_hashes(spark, sf):
    """Digests of customers by segment against recorded ones: two segments grew, one of them by an amendment on record, one is gone and one is new."""
    c = table(spark, sf, "customer").select(*DIGESTED)
    then = c.where(~(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE") & (F.col("c_custkey") % 50 == 0)) & (F.col("c_mktsegment") != "MACHINERY"))
    documented = spark.createDataFrame([("BUILDING", "digest"), ("BUILDING", "rows")], "artefact string, what string")
    recorded, current = (V.table_digest(d, "c_mktsegment", DIGESTED) for d in (then, c.where("c_mktsegment <> 'FURNITURE'")))
    return V.recorded_hashes(recorded, current, documented)


EXPECTED = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_nothing"]


@query(f"""SELECT coalesce(e.name, d.column_name) AS name, CASE WHEN d.column_name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' ELSE 'ok' END AS status
 FROM (SELECT unnest({EXPECTED}) AS name) e FULL OUTER JOIN (SELECT column_name FROM (DESCRIBE lineitem)) d ON d.column_name = e.name""")
def schema_check(spark, sf):
    return A.schema_check(table(spark, sf, "lineitem"), EXPECTED)


# ---- cleaners refitted on rolling cuts, finished archives ------------------------------------------------------------

CUTS = {"first": "1998-01-01", "second": "2000-01-01", "last": "2003-01-01"}


@query("SELECT * FROM (" + " UNION ALL ".join("SELECT * FROM (" + with_sql(f"SELECT '{name}' AS cut, feature, median, log1p, mean, std FROM params WHERE feature IN ({', '.join(repr(c) for c in KEPT)})", FEATURES, f"train AS (SELECT * FROM feat WHERE t_ms < epoch_us(TIMESTAMP '{day}') / 1000.0)", stats_sql("train", "params")) + ")" for name, day in CUTS.items()) + ")")
def clean_refit_cut(spark, sf):
    """The cleaner of each cut, fitted on what came before it and held to the frozen features."""
    f, parts = features(spark, sf), []
    for name, day in CUTS.items():
        before = f.where(F.col("t_ms") < F.unix_micros(F.to_timestamp_ltz(F.lit(day))) / 1000.0)
        parts.append(K.restrict(K.fit(before, COLUMNS, HEAVY), KEPT).select(F.lit(name).alias("cut"), "feature", "median", "log1p", "mean", "std"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def finalize_sql(scheme: str, *parts: str) -> str:
    counts = "(SELECT count(*) FROM (SELECT DISTINCT e.grp, e.rn FROM exploded e JOIN placed p USING (grp, k) WHERE p.window_id IN (SELECT window_id FROM sets))) AS rows_materialised"
    return "SELECT * FROM (" + windowed(f"SELECT '{scheme}' AS scheme, {counts}, (SELECT count(DISTINCT window_id) FROM sets) AS windows_referenced, CAST(2 AS BIGINT) AS n_features, CAST(0 AS BIGINT) AS violations", *parts) + ")"


@query(finalize_sql("temporal_gap", *SETS) + " UNION ALL " + finalize_sql("grouped_random", SPLIT_RANDOM, *SETS[1:]))
def archive_finalize(spark, sf):
    """For each split: the referenced flows numbered anew, cleaned as the train flows say, written, read again and verified."""
    w, flows, out = windows(spark, sf), numbered(spark, sf), None
    for scheme, split in (("temporal_gap", S.split_temporal_gap(w)), ("grouped_random", S.split_grouped_random(w, SEED))):
        placed = S.with_split(w, split)
        members = S.make_sets(placed, SEED)
        train = flows.join(split.where("split = 'train'").select("grp"), "grp", "left_semi")
        path = T.finalize(T.shared_path(spark, scheme), flows, placed, members, K.restrict(K.fit(train, ["f1", "f2"], ["f1"]), ["f1", "f2"]), SIZE, STRIDE)
        row = T.archive_report(spark, path, ["f1", "f2"]).select(F.lit(scheme).alias("scheme"), "*")
        out = row if out is None else out.unionByName(row)
    return out
