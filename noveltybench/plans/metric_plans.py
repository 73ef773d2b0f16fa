"""Queries: ranking metrics, resampling and the result cube, on scores of the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltybench.functions.sampling import md5_draw
from noveltybench.operators import cube as C
from noveltybench.operators import metrics as M
from noveltybench.operators.ranks import midranks
from noveltybench.plans.base import kept, query, table, with_sql

DETECTORS = ["dim1", "dim2", "pair", "quad"]


def _dim(i: int):
    return F.element_at("embedding", i).cast("double")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, cls, y, grp and one column for each detector."""
    d = [_dim(i) for i in range(1, 5)]
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cls"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 20).alias("grp"), d[0].alias("dim1"), d[1].alias("dim2"), F.round(d[0] + d[2], 2).alias("pair"), (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + d[3] * d[3]).alias("quad"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long score table: vec_id, cls, y, grp, detector, score."""
    return wide(spark, sf).unpivot(["vec_id", "cls", "y", "grp"], DETECTORS, "detector", "score")


WIDE = """wide AS (SELECT vec_id, label AS cls, CAST(label >= 5 AS INTEGER) AS y, vec_id % 20 AS grp, e1 AS dim1, e2 AS dim2, round(e1 + e3, 2) AS pair, e1 * e1 + e2 * e2 + e3 * e3 + e4 * e4 AS quad
  FROM (SELECT *, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(embedding[3] AS DOUBLE) AS e3, CAST(embedding[4] AS DOUBLE) AS e4 FROM embeddings))"""
SCORES = WIDE + """, scores AS (SELECT vec_id, cls, y, grp, 'dim1' AS detector, dim1 AS score FROM wide UNION ALL SELECT vec_id, cls, y, grp, 'dim2', dim2 FROM wide
  UNION ALL SELECT vec_id, cls, y, grp, 'pair', pair FROM wide UNION ALL SELECT vec_id, cls, y, grp, 'quad', quad FROM wide)"""


def levels_sql(source: str, keys: str, weight: str = "1.0") -> str:
    return f"""lev0 AS (SELECT {keys}, score, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END)::DOUBLE AS neg FROM {source} GROUP BY {keys}, score),
lev AS (SELECT *, coalesce(sum(pos) OVER b, 0) AS pos_before, coalesce(sum(neg) OVER b, 0) AS neg_before, sum(pos) OVER (PARTITION BY {keys}) AS all_pos, sum(neg) OVER (PARTITION BY {keys}) AS all_neg FROM lev0
 WINDOW b AS (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


LEV = levels_sql("scores", "detector")
AUC = "sum(pos * (neg_before + neg / 2)) / (max(all_pos) * max(all_neg))"


@query(with_sql(f"SELECT detector, {AUC} AS auc FROM lev GROUP BY detector", SCORES, LEV))
def metric_auc(spark, sf):
    return M.auc(scores(spark, sf), ["detector"])


PR = "sum(pos / all_pos * (all_pos - pos_before) / (all_pos - pos_before + all_neg - neg_before))"


@query(with_sql(f"SELECT detector, {PR} AS pr_auc FROM lev GROUP BY detector", SCORES, LEV))
def metric_pr_auc(spark, sf):
    return M.pr_auc(scores(spark, sf), ["detector"])


TPR = "max(CASE WHEN (all_neg - neg_before) / all_neg <= 0.05 THEN (all_pos - pos_before) / all_pos ELSE 0 END)"


@query(with_sql(f"SELECT detector, {TPR} AS tpr FROM lev GROUP BY detector", SCORES, LEV))
def metric_tpr_at_fpr(spark, sf):
    return M.tpr_at_fpr(scores(spark, sf), ["detector"], 0.05)


DP = "(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0)) / sqrt((var_samp(score) FILTER (y = 1) + var_samp(score) FILTER (y = 0)) / 2 + 1e-24)"


@query(with_sql(f"SELECT detector, {DP} AS d_prime FROM scores GROUP BY detector", SCORES))
def metric_d_prime(spark, sf):
    return M.d_prime(scores(spark, sf), ["detector"])


VAL = "thr AS (SELECT detector, quantile_cont(score, 0.95) AS threshold FROM scores WHERE y = 0 AND grp < 10 GROUP BY detector)"


def thresholds(spark, sf):
    return M.threshold_at_fpr(scores(spark, sf).where("grp < 10"), ["detector"], 0.05)


@query(with_sql("SELECT detector, threshold FROM thr", SCORES, VAL))
def threshold_at_val_fpr(spark, sf):
    return thresholds(spark, sf)


CONF = "conf AS (SELECT detector, (count(*) FILTER (score > threshold AND y = 1))::DOUBLE AS tp, (count(*) FILTER (score > threshold AND y = 0))::DOUBLE AS fp, (count(*) FILTER (score <= threshold AND y = 1))::DOUBLE AS fn, (count(*) FILTER (score <= threshold AND y = 0))::DOUBLE AS tn FROM scores JOIN thr USING (detector) WHERE grp >= 10 GROUP BY detector)"


def confused(spark, sf):
    return M.confusion(scores(spark, sf).where("grp >= 10"), thresholds(spark, sf), ["detector"])


@query(with_sql("SELECT detector, tp / (tp + fn) AS tpr FROM conf", SCORES, VAL, CONF))
def tpr_at_val_threshold(spark, sf):
    return confused(spark, sf).select("detector", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("tpr"))


F1 = "(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2"
MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END"


@query(with_sql(f"SELECT detector, {F1} AS macro_f1 FROM conf", SCORES, VAL, CONF))
def metric_macro_f1(spark, sf):
    return M.macro_f1(confused(spark, sf), ["detector"])


@query(with_sql(f"SELECT detector, {MCC} AS mcc FROM conf", SCORES, VAL, CONF))
def metric_mcc(spark, sf):
    return M.mcc(confused(spark, sf), ["detector"])


@query(with_sql(f"SELECT * FROM (SELECT detector, {AUC} AS auc, {PR} AS pr_auc, {TPR} AS tpr FROM lev GROUP BY detector) JOIN (SELECT detector, {DP} AS d_prime FROM scores GROUP BY detector) USING (detector) JOIN (SELECT detector, {F1} AS macro_f1, {MCC} AS mcc FROM conf) USING (detector)", SCORES, LEV, VAL, CONF))
def detection_summary(spark, sf):
    s, k = scores(spark, sf), ["detector"]
    c = confused(spark, sf)
    return M.ranking_summary(s, k, 0.05).join(M.d_prime(s, k), k).join(M.macro_f1(c, k), k).join(M.mcc(c, k), k)


@query(with_sql("""SELECT detector, (rank() OVER (PARTITION BY detector ORDER BY score) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY detector) - 1) AS rank01, vec_id FROM scores""", SCORES))
def ranks01(spark, sf):
    s = scores(spark, sf)
    n = s.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    return midranks(s, ["detector"], "score").join(F.broadcast(n), "detector").select("detector", "vec_id", ((F.col("midrank") - 1) / (F.col("n") - 1)).alias("rank01"))


def mid(x: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    both = f"{keys}, {x}" if keys else x
    return f"(rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {both}) - 1) / 2.0)"


@query(with_sql(f"SELECT cls, corr(rx, ry) AS rho FROM (SELECT cls, {mid('dim1', 'cls')} AS rx, {mid('pair', 'cls')} AS ry FROM wide) GROUP BY cls", WIDE))
def spearman_rho(spark, sf):
    return M.spearman(wide(spark, sf), ["cls"], "dim1", "pair")


def draws_sql(source: str, unit: str, reps: int, seed: int, out: str) -> str:
    return f"""{out}_u AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS idx FROM (SELECT DISTINCT {unit} FROM {source})), {out}_d AS (
 SELECT rep, CAST('0x' || substr(md5('{seed}:' || rep || ':' || u.idx), 1, 8) AS BIGINT) % (SELECT count(*) FROM {out}_u) AS idx FROM {out}_u u, (SELECT unnest(range(0, {reps})) AS rep)),
{out} AS (SELECT rep, {unit}, count(*) AS times FROM {out}_d JOIN {out}_u USING (idx) GROUP BY rep, {unit})"""


@query(with_sql(f"SELECT detector, count(auc) AS reps, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM (SELECT detector, rep, {AUC} AS auc FROM lev GROUP BY detector, rep) GROUP BY detector",
                SCORES, draws_sql("scores", "grp", 40, 5, "dr"), "drawn AS (SELECT s.*, rep, times FROM scores s JOIN dr USING (grp))", levels_sql("drawn", "detector, rep", "times")))
def group_bootstrap_metric(spark, sf):
    return M.percentile_interval(M.group_bootstrap_auc(scores(spark, sf), ["detector"], "grp", 40, 5), ["detector"], "auc")


DELONG = f"""v0 AS (SELECT y, {mid('dim1')} - {mid('dim1', 'y')} AS a, {mid('quad')} - {mid('quad', 'y')} AS b FROM wide), c AS (SELECT count(*) FILTER (y = 1) AS m, count(*) FILTER (y = 0) AS n FROM wide),
v AS (SELECT y, CASE WHEN y = 1 THEN a / n ELSE 1 - a / m END AS a, CASE WHEN y = 1 THEN b / n ELSE 1 - b / m END AS b FROM v0, c),
per AS (SELECT y, avg(a) AS aa, avg(b) AS bb, (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) AS s FROM v GROUP BY y)"""


@query(with_sql("SELECT max(aa) FILTER (y = 1) AS auc_a, max(bb) FILTER (y = 1) AS auc_b, (max(aa) FILTER (y = 1) - max(bb) FILTER (y = 1)) / sqrt(sum(s)) AS z FROM per", WIDE, DELONG))
def delong_test(spark, sf):
    return M.delong(wide(spark, sf), "dim1", "quad").select("auc_a", "auc_b", "z")


# ---- result cube: AUC of each class against benign rows, by detector and seed ---------------------------------

SEEDS = 5


@kept("result_cube")
def result_cube(spark: SparkSession, sf: str) -> DataFrame:
    """(cls, detector, seed, auc): seeds are md5 half samples, class 5..9 against all benign rows of the half."""
    s = scores(spark, sf).crossJoin(F.broadcast(spark.range(SEEDS).withColumnRenamed("id", "seed")))
    half = s.where(md5_draw(F.concat_ws(":", "vec_id", "seed"), 2) == 0)
    targets = half.where("y = 1").select("cls").distinct().withColumnRenamed("cls", "target")
    attack = half.where("y = 1").withColumn("target", F.col("cls"))
    benign = half.where("y = 0").crossJoin(F.broadcast(targets))
    return M.auc(attack.unionByName(benign), ["target", "detector", "seed"]).withColumnRenamed("target", "cls")


CUBE = ", ".join([SCORES, f"halves AS (SELECT s.*, seed FROM scores s, (SELECT unnest(range(0, {SEEDS})) AS seed) WHERE CAST('0x' || substr(md5(vec_id || ':' || seed), 1, 8) AS BIGINT) % 2 = 0)",
                  "targeted AS (SELECT *, cls AS target FROM halves WHERE y = 1 UNION ALL SELECT h.*, t.target FROM halves h, (SELECT DISTINCT cls AS target FROM halves WHERE y = 1) t WHERE y = 0)",
                  levels_sql("targeted", "target, detector, seed"), f"cube0 AS (SELECT target AS cls, detector, seed, {AUC} AS auc FROM lev GROUP BY target, detector, seed)"])
FAM = "CASE WHEN detector IN ('dim1', 'dim2') THEN 'single' ELSE 'mixed' END"


@query(with_sql("SELECT cls, detector, seed, auc FROM cube0", CUBE))
def runs_to_long(spark, sf):
    """The cube from nested run records: one map of maps for each seed, exploded again."""
    return C.runs_to_long(C.nest_runs(result_cube(spark, sf)))


@query(with_sql("""SELECT cls, detector, n, mean, CASE n WHEN 5 THEN 2.776 WHEN 4 THEN 3.182 WHEN 3 THEN 4.303 WHEN 2 THEN 12.706 END * s / sqrt(n) AS half_width FROM (SELECT cls, detector, count(auc) AS n, avg(auc) AS mean, stddev_samp(auc) AS s FROM cube0 GROUP BY cls, detector)""", CUBE))
def mean_ci_t(spark, sf):
    return M.mean_ci_t(result_cube(spark, sf), ["cls", "detector"], "auc")


@query(with_sql("SELECT cls, detector, avg(auc) AS mean, stddev_samp(auc) AS sd, avg(CAST(auc < 0.5 AS INTEGER)) AS below_half, avg(auc) < 0.5 AS inverted FROM cube0 GROUP BY cls, detector", CUBE))
def aggregate_points(spark, sf):
    return C.aggregate_points(result_cube(spark, sf))


@query(with_sql("SELECT detector, avg(sd) AS seed_sd FROM (SELECT cls, detector, stddev_samp(auc) AS sd FROM cube0 GROUP BY cls, detector) GROUP BY detector", CUBE))
def seed_std(spark, sf):
    return C.aggregate_points(result_cube(spark, sf)).groupBy("detector").agg(F.avg("sd").alias("seed_sd"))


@query(with_sql("SELECT detector, avg(CAST(auc < 0.5 AS INTEGER)) AS share FROM cube0 GROUP BY detector", CUBE))
def frac_below_half(spark, sf):
    return result_cube(spark, sf).groupBy("detector").agg(F.avg((F.col("auc") < 0.5).cast("int")).alias("share"))


FAMILY_OF = {"dim1": "single", "dim2": "single", "pair": "mixed", "quad": "mixed"}
FM = f"fm AS (SELECT cls, seed, {FAM} AS family, avg(auc) AS value FROM cube0 GROUP BY ALL)"


def fam(spark, sf):
    return C.family_matrix(result_cube(spark, sf), FAMILY_OF)


@query(with_sql("SELECT cls, seed, family, value FROM fm", CUBE, FM))
def family_matrix(spark, sf):
    return fam(spark, sf)


@query(with_sql("SELECT a.cls, a.seed, a.value - b.value AS difference FROM fm a JOIN fm b USING (cls, seed) WHERE a.family = 'mixed' AND b.family = 'single'", CUBE, FM))
def family_contrast(spark, sf):
    return C.family_contrast(fam(spark, sf), "mixed", "single")


@query(with_sql("SELECT cls, arg_max(family, value) AS leader FROM (SELECT cls, family, avg(value) AS value FROM fm GROUP BY cls, family) GROUP BY cls", CUBE, FM))
def family_leader(spark, sf):
    return C.family_leader(fam(spark, sf))


@query(with_sql("SELECT CASE WHEN grouping(cls) = 0 THEN 'class' WHEN grouping(detector) = 0 THEN 'detector' ELSE 'all' END AS dimension, coalesce(CAST(cls AS VARCHAR), detector, 'all') AS member, avg(auc) AS mean, count(*) AS n FROM cube0 GROUP BY GROUPING SETS ((cls), (detector), ())", CUBE))
def pool_by_dimension(spark, sf):
    return C.pool_by_dimension(result_cube(spark, sf))


def lohi(spark, sf):
    """Detector means under two protocols: even and odd classes."""
    return C.protocol_means(result_cube(spark, sf).withColumn("protocol", F.when(F.col("cls") % 2 == 0, "even").otherwise("odd")), "even", "odd")


LOHI = "pm AS (SELECT detector, avg(auc) FILTER (cls % 2 = 0) AS a, avg(auc) FILTER (cls % 2 = 1) AS b FROM cube0 GROUP BY detector)"


@query(with_sql("SELECT 'all' AS config, sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(sign(x.a - y.a) ** 2) * sum(sign(x.b - y.b) ** 2)) AS tau FROM pm x JOIN pm y ON x.detector < y.detector", CUBE, LOHI))
def kendall_tau(spark, sf):
    return M.kendall_tau(lohi(spark, sf).withColumn("config", F.lit("all")), ["config"], "detector", "a", "b")


@query(with_sql("""SELECT avg(b - a) AS mean_delta, avg(abs(b - a)) AS mean_abs_delta, max(abs(b - a)) AS max_abs_delta, median(b - a) AS median_delta, arg_max(detector, a) = arg_max(detector, b) AS same_winner,
  max(b) - arg_max(b, a) AS regret, CAST(count(*) FILTER ((a < 0.5) <> (b < 0.5)) AS BIGINT) AS side_flips,
  (SELECT CAST(count(*) FILTER ((x.a - y.a) * (x.b - y.b) < 0) AS BIGINT) FROM pm x JOIN pm y ON x.detector < y.detector) AS discordant FROM pm""", CUBE, LOHI))
def protocol_agreement(spark, sf):
    return C.protocol_agreement(lohi(spark, sf))


def seeds_apart(spark, sf):
    """Detectors under two protocols (even and odd classes) for each seed, with the least area as a second measure."""
    odd = F.col("cls") % 2 == 1
    sides = [f(F.when(side, F.col("auc"))).alias(name) for name, f, side in (("a", F.avg, ~odd), ("b", F.avg, odd), ("c", F.min, ~odd), ("d", F.min, odd))]
    means = result_cube(spark, sf).groupBy("seed", "detector").agg(*sides)
    return means.withColumn("family", F.create_map(*[F.lit(x) for kv in FAMILY_OF.items() for x in kv])[F.col("detector")])


RANKED = [f"sm AS (SELECT seed, detector, {FAM} AS family, avg(auc) FILTER (cls % 2 = 0) AS a, avg(auc) FILTER (cls % 2 = 1) AS b, min(auc) FILTER (cls % 2 = 0) AS c, min(auc) FILTER (cls % 2 = 1) AS d FROM cube0 GROUP BY ALL)",
          "sr AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY a DESC, detector) AS ra, row_number() OVER (PARTITION BY seed ORDER BY b DESC, detector) AS rb FROM sm)",
          "sf AS (SELECT seed, arg_max(family, a) AS leader_a, arg_max(family, b) AS leader_b FROM (SELECT seed, family, avg(a) AS a, avg(b) AS b FROM sm GROUP BY ALL) GROUP BY seed)"]


@query(with_sql("""SELECT seed, avg(abs(ra - rb)) AS mean_rank_shift, max(abs(ra - rb)) AS max_rank_shift, CAST(count(*) FILTER ((a - 0.5) * (b - 0.5) < 0) AS BIGINT) AS chance_side_flips,
 max(detector) FILTER (ra = 1) AS pick, max(rb) FILTER (ra = 1) AS pick_rank, max(b) FILTER (ra = 1) AS pick_value, max(d) FILTER (ra = 1) AS pick_second, max(b) FILTER (rb = 1) - max(b) FILTER (ra = 1) AS regret,
 max(d) FILTER (rb = 1) - max(d) FILTER (ra = 1) AS second_regret, avg(d - c) AS mean_second_delta, avg(abs(d - c)) AS mean_abs_second_delta, any_value(leader_a) AS leader_a, any_value(leader_b) AS leader_b, any_value(leader_a <> leader_b) AS leader_flip
 FROM sr JOIN sf USING (seed) GROUP BY seed""", CUBE, *RANKED))
def protocol_agreement_ranks(spark, sf):
    return C.agreement_ranks(seeds_apart(spark, sf), ["seed"])


@query(with_sql("SELECT low, high, reps FROM (SELECT count(mean) AS reps, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM (SELECT rep, sum(a.times * b.times * auc) / sum(a.times * b.times) AS mean FROM quad q JOIN da a USING (cls) JOIN db b USING (rep, seed) GROUP BY rep))",
                CUBE, "quad AS (SELECT * FROM cube0 WHERE detector = 'quad')", draws_sql("quad", "cls", 200, 7, "da"), draws_sql("quad", "seed", 200, 8, "db")))
def bootstrap_unit_seed(spark, sf):
    q = result_cube(spark, sf).where("detector = 'quad'")
    return M.percentile_interval(M.two_way_bootstrap(q, "cls", "seed", "auc", 200, 7), [], "mean")


@query(with_sql("SELECT low, high, reps FROM (SELECT count(mean) AS reps, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM (SELECT rep, sum(a.times * b.times * auc) / sum(a.times * b.times) AS mean FROM quad q JOIN da a USING (cluster) JOIN db b USING (rep, seed) GROUP BY rep))",
                CUBE, "quad AS (SELECT *, cls % 3 AS cluster FROM cube0 WHERE detector = 'quad')", draws_sql("quad", "cluster", 200, 9, "da"), draws_sql("quad", "seed", 200, 10, "db")))
def bootstrap_cluster_seed(spark, sf):
    q = result_cube(spark, sf).where("detector = 'quad'").withColumn("cluster", F.col("cls") % 3)
    return M.percentile_interval(M.two_way_bootstrap(q, "cluster", "seed", "auc", 200, 9), [], "mean")


PV = "pv AS (SELECT cls, 1 - max(auc) AS p FROM cube0 GROUP BY cls)"


@query(with_sql("SELECT cls, p, least(1.0, max(s) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS adjusted FROM (SELECT *, (count(*) OVER () - i) * p AS s FROM (SELECT *, row_number() OVER (ORDER BY p, cls) - 1 AS i FROM pv))", CUBE, PV))
def holm_adjust(spark, sf):
    return M.holm(result_cube(spark, sf).groupBy("cls").agg((1 - F.max("auc")).alias("p")), "p", "cls")


@query(with_sql("SELECT predicted, observed, count(*) AS n FROM (SELECT cls, detector, avg(auc) FILTER (seed = 0) < 0.5 AS predicted, avg(auc) FILTER (seed > 0) < 0.5 AS observed FROM cube0 GROUP BY cls, detector) GROUP BY ALL", CUBE))
def inversion_table(spark, sf):
    return C.inversion_table(result_cube(spark, sf))


@query(with_sql("SELECT detector, c5, c6, c7, c8, c9 FROM (SELECT detector, avg(auc) FILTER (cls = 5) AS c5, avg(auc) FILTER (cls = 6) AS c6, avg(auc) FILTER (cls = 7) AS c7, avg(auc) FILTER (cls = 8) AS c8, avg(auc) FILTER (cls = 9) AS c9 FROM cube0 GROUP BY detector)", CUBE))
def transfer_matrix(spark, sf):
    p = result_cube(spark, sf).groupBy("detector").pivot("cls", [5, 6, 7, 8, 9]).agg(F.avg("auc"))
    return p.select("detector", *[F.col(str(c)).alias(f"c{c}") for c in (5, 6, 7, 8, 9)])


@query(with_sql("SELECT detector, avg(CAST(m BETWEEN 0.45 AND 0.55 AS INTEGER)) AS in_band, avg(CAST(m < 0.45 AS INTEGER)) AS below, avg(CAST(m > 0.55 AS INTEGER)) AS above, median(m) AS median FROM (SELECT detector, cls, avg(auc) AS m FROM cube0 GROUP BY detector, cls) GROUP BY detector", CUBE))
def transfer_band_shares(spark, sf):
    return C.band_shares(C.aggregate_points(result_cube(spark, sf)), 0.45, 0.55)


@query(with_sql("SELECT detector, a - b AS degradation, a - b > 0.05 AS flagged FROM pm", CUBE, LOHI))
def split_degradation(spark, sf):
    return lohi(spark, sf).select("detector", (F.col("a") - F.col("b")).alias("degradation"), (F.col("a") - F.col("b") > 0.05).alias("flagged"))


@query(with_sql("SELECT f.cls, f.detector, f.auc - b.best AS delta FROM (SELECT cls, detector, auc FROM cube0 WHERE seed = 4) f JOIN (SELECT cls, detector, max(auc) AS best FROM cube0 GROUP BY cls, detector) b USING (cls, detector)", CUBE))
def checkpoint_delta(spark, sf):
    c = result_cube(spark, sf)
    best = c.groupBy("cls", "detector").agg(F.max("auc").alias("best"))
    return c.where("seed = 4").join(best, ["cls", "detector"]).select("cls", "detector", (F.col("auc") - F.col("best")).alias("delta"))


@query(with_sql("SELECT 'complete_grid' AS check_name, CAST(20 * 5 - count(*) + count(*) FILTER (seed NOT BETWEEN 0 AND 4) AS BIGINT) AS violations, 20 * 5 - count(*) = 0 AS ok FROM cube0", CUBE))
def verify_complete_grid(spark, sf):
    c = result_cube(spark, sf)
    return C.complete_grid(c, ["cls", "detector"], "seed", SEEDS)


@query(with_sql("SELECT family, avg(value) AS mean, CAST(count(DISTINCT cls) AS BIGINT) AS units FROM fm GROUP BY family", CUBE, FM))
def protocol_winners(spark, sf):
    return fam(spark, sf).groupBy("family").agg(F.avg("value").alias("mean"), F.countDistinct("cls").alias("units"))


@query(with_sql("SELECT count(*) AS points, median(auc) AS median_auc FROM (SELECT cls, detector, avg(auc) AS auc FROM cube0 GROUP BY cls, detector) WHERE auc >= 0.5", CUBE))
def operating_point_illusion(spark, sf):
    return C.aggregate_points(result_cube(spark, sf)).where("mean >= 0.5").agg(F.count(F.lit(1)).alias("points"), F.percentile("mean", 0.5).alias("median_auc"))


@query(with_sql("SELECT detector, inversions, drift, inversions <= 2 AS passes_inversions, drift <= 0.05 AS passes_drift FROM (SELECT detector, CAST(count(*) FILTER (m < 0.5) AS BIGINT) AS inversions, median(sd) AS drift FROM (SELECT detector, cls, avg(auc) AS m, stddev_samp(auc) AS sd FROM cube0 GROUP BY detector, cls) GROUP BY detector)", CUBE))
def gate_detector_count(spark, sf):
    p = C.aggregate_points(result_cube(spark, sf))
    g = p.groupBy("detector").agg(F.count_if(F.col("mean") < 0.5).alias("inversions"), F.percentile("sd", 0.5).alias("drift"))
    return g.withColumn("passes_inversions", F.col("inversions") <= 2).withColumn("passes_drift", F.col("drift") <= 0.05)


@query(with_sql("SELECT avg(a.value - b.value) AS gap, avg(a.value - b.value) >= 0.15 AS go FROM fm a JOIN fm b USING (cls, seed) WHERE a.family = 'mixed' AND b.family = 'single'", CUBE, FM))
def gate_family_gap(spark, sf):
    return C.family_contrast(fam(spark, sf), "mixed", "single").agg(F.avg("difference").alias("gap")).withColumn("go", F.col("gap") >= 0.15)


@query(with_sql("SELECT claim, holds FROM (SELECT 'all areas lie in 0..1' AS claim, bool_and(auc BETWEEN 0 AND 1) AS holds FROM cube0 UNION ALL SELECT 'every detector has every seed', count(DISTINCT detector || seed) = 20 FROM cube0)", CUBE))
def claim_checks(spark, sf):
    c = result_cube(spark, sf)
    one = c.agg(F.every(F.col("auc").between(0, 1)).alias("holds")).select(F.lit("all areas lie in 0..1").alias("claim"), "holds")
    return one.unionByName(c.agg((F.countDistinct("detector", "seed") == 20).alias("holds")).select(F.lit("every detector has every seed").alias("claim"), "holds"))


RHO = f"rho AS (SELECT corr(rx, ry) AS rho FROM (SELECT {mid('a')} AS rx, {mid('b')} AS ry FROM (SELECT cls, detector, avg(auc) FILTER (seed = 0) AS a, avg(auc) FILTER (seed > 0) AS b FROM cube0 GROUP BY cls, detector)))"


def point_rho(spark, sf):
    p = result_cube(spark, sf).groupBy("cls", "detector").agg(F.round(F.avg(F.when(F.col("seed") == 0, F.col("auc"))), 9).alias("a"), F.round(F.avg(F.when(F.col("seed") > 0, F.col("auc"))), 9).alias("b"))
    return M.spearman(p, [], "a", "b", 1)


@query(with_sql("SELECT rho, rho >= 0.6 AS go FROM rho", CUBE, RHO))
def gate_rho(spark, sf):
    return point_rho(spark, sf).withColumn("go", F.col("rho") >= 0.6)


@query(with_sql("SELECT rho, CASE WHEN rho >= 0.6 THEN 'go' WHEN rho >= 0.3 THEN 'revise' ELSE 'stop' END AS decision FROM rho", CUBE, RHO))
def gate_tiered_decision(spark, sf):
    return point_rho(spark, sf).withColumn("decision", F.when(F.col("rho") >= 0.6, "go").when(F.col("rho") >= 0.3, "revise").otherwise("stop"))


@query(with_sql("SELECT cls, stddev_samp(auc) FILTER (seed < 3) AS before_sd, stddev_samp(auc) AS after_sd FROM cube0 WHERE detector = 'quad' GROUP BY cls", CUBE))
def pre_post_spread(spark, sf):
    q = result_cube(spark, sf).where("detector = 'quad'")
    return q.groupBy("cls").agg(F.stddev_samp(F.when(F.col("seed") < 3, F.col("auc"))).alias("before_sd"), F.stddev_samp("auc").alias("after_sd"))


@query(with_sql("SELECT s.detector, s.cls, (avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0)) / sqrt((var_samp(score) FILTER (y = 1) + var_samp(score) FILTER (y = 0)) / 2 + 1e-24) AS d_prime FROM t s GROUP BY s.detector, s.cls",
                SCORES, "t AS (SELECT detector, cls, y, score FROM scores WHERE y = 1 UNION ALL SELECT b.detector, c.cls, 0, b.score FROM scores b, (SELECT DISTINCT cls FROM scores WHERE y = 1) c WHERE b.y = 0)"))
def per_class_dprime(spark, sf):
    s = scores(spark, sf).select("detector", "cls", "y", "score")
    targets = s.where("y = 1").select("cls").distinct()
    return M.d_prime(s.where("y = 1").unionByName(s.where("y = 0").drop("cls").crossJoin(F.broadcast(targets))), ["detector", "cls"])


@query(with_sql("SELECT detector, (avg(score) FILTER (grp >= 10 AND y = 0) - avg(score) FILTER (grp < 10 AND y = 0)) / sqrt((var_samp(score) FILTER (grp >= 10 AND y = 0) + var_samp(score) FILTER (grp < 10 AND y = 0)) / 2 + 1e-24) AS benign_drift, (avg(score) FILTER (grp >= 10 AND y = 1) - avg(score) FILTER (grp < 10 AND y = 0)) / sqrt((var_samp(score) FILTER (grp >= 10 AND y = 1) + var_samp(score) FILTER (grp < 10 AND y = 0)) / 2 + 1e-24) AS attack_shift FROM scores GROUP BY detector", SCORES))
def drift_dprime_grid(spark, sf):
    s = scores(spark, sf)
    val = s.where("grp < 10 and y = 0").withColumn("y", F.lit(0))
    drift = M.d_prime(val.unionByName(s.where("grp >= 10 and y = 0").withColumn("y", F.lit(1))), ["detector"]).withColumnRenamed("d_prime", "benign_drift")
    shift = M.d_prime(val.unionByName(s.where("grp >= 10 and y = 1")), ["detector"]).withColumnRenamed("d_prime", "attack_shift")
    return drift.join(shift, "detector")
