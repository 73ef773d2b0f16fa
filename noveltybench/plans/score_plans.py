"""Queries: spectral and recurrence operators, score functions and detectors on the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltybench.functions.sampling import md5_draw
from noveltybench.operators import boosting as B
from noveltybench.operators import detectors as D
from noveltybench.operators import scores as K
from noveltybench.operators.ranks import running
from noveltybench.plans.base import kept, query, table, with_sql


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").alias("cls"), (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"))


VEC = "vec AS (SELECT vec_id, label AS cls, CAST(label >= 5 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def channel(c: int):
    """The 32 steps of one of two channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.element_at("x", (t * 2 + 1 + c).cast("int")))


@kept("power")
def powers(spark, sf):
    """(vec_id, cls, y, channel, w, p)."""
    v = vectors(spark, sf)
    spread = v.select("vec_id", "cls", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), K.power(channel(c), 32).alias("ps")) for c in (0, 1)])).alias("z"))
    return spread.select("vec_id", "cls", "y", F.col("z.channel").alias("channel"), F.posexplode("z.ps").alias("w", "p"))


POWER = """pos AS (SELECT vec_id, cls, y, c AS channel, t, x[t * 2 + 1 + c] AS v FROM vec, (SELECT unnest(range(0, 32)) AS t), (SELECT unnest([0, 1]) AS c)),
pw AS (SELECT vec_id, cls, y, channel, CAST(w AS INTEGER) AS w, (pow(sum(v * cos(2 * pi() * w * t / 32)), 2) + pow(sum(v * sin(2 * pi() * w * t / 32)), 2)) * CASE WHEN w IN (0, 16) THEN 1 ELSE 2 END / 1024.0 AS p FROM pos, (SELECT unnest(range(0, 17)) AS w) GROUP BY vec_id, cls, y, channel, w)"""


@query(with_sql("SELECT vec_id, channel, w, round(p, 9) AS p FROM pw", VEC, POWER))
def window_power(spark, sf):
    return powers(spark, sf).select("vec_id", "channel", "w", F.round("p", 9).alias("p"))


@query(with_sql("SELECT channel, w, avg(p) AS p FROM pw GROUP BY channel, w", VEC, POWER))
def channel_power(spark, sf):
    return powers(spark, sf).groupBy("channel", "w").agg(F.avg("p").alias("p"))


ENERGY = "band AS (SELECT vec_id, cls, y, sum(p / (1 + w)) AS energy FROM pw GROUP BY vec_id, cls, y)"


def band(spark, sf):
    """In-band energy under the gain 1 / (1 + w)."""
    gain = spark.range(17).select(F.col("id").cast("int").alias("w"), (1 / (1 + F.col("id"))).alias("gain"))
    return powers(spark, sf).join(F.broadcast(gain), "w").groupBy("vec_id", "cls", "y").agg(F.sum(F.col("p") * F.col("gain")).alias("energy"))


@query(with_sql("SELECT vec_id, round(energy, 9) AS energy FROM band", VEC, POWER, ENERGY))
def in_band_energy(spark, sf):
    return band(spark, sf).select("vec_id", F.round("energy", 9).alias("energy"))


@query(with_sql("SELECT cls, (avg(energy) - (SELECT avg(energy) FROM band WHERE y = 0)) / greatest((SELECT stddev_samp(energy) FROM band WHERE y = 0), 1e-12) AS d FROM band WHERE y = 1 GROUP BY cls", VEC, POWER, ENERGY))
def detectability_index(spark, sf):
    b = band(spark, sf)
    ref = b.where("y = 0").agg(F.avg("energy").alias("m"), F.greatest(F.stddev_samp("energy"), F.lit(1e-12)).alias("s"))
    return b.where("y = 1").groupBy("cls").agg(F.avg("energy").alias("e")).crossJoin(F.broadcast(ref)).select("cls", ((F.col("e") - F.col("m")) / F.col("s")).alias("d"))


@query(with_sql("SELECT a.cls, sum(pow(a.p - b.p, 2) / pow(1 + w, 2)) AS distance FROM (SELECT cls, channel, w, avg(p) AS p FROM pw WHERE y = 1 GROUP BY ALL) a JOIN (SELECT channel, w, avg(p) AS p FROM pw WHERE y = 0 GROUP BY ALL) b USING (channel, w) GROUP BY a.cls", VEC, POWER))
def spectral_distance(spark, sf):
    p = powers(spark, sf)
    a = p.where("y = 1").groupBy("cls", "channel", "w").agg(F.avg("p").alias("a"))
    b = p.where("y = 0").groupBy("channel", "w").agg(F.avg("p").alias("b"))
    return a.join(F.broadcast(b), ["channel", "w"]).groupBy("cls").agg(F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2)) / F.pow(1 + F.col("w"), F.lit(2))).alias("distance"))


@query(with_sql("SELECT seed, sum(pow(a - b, 2) / pow(1 + w, 2)) AS distance FROM (SELECT seed, channel, w, avg(p) FILTER (h = 0) AS a, avg(p) FILTER (h = 1) AS b FROM (SELECT *, CAST('0x' || substr(md5(vec_id || ':' || seed), 1, 8) AS BIGINT) % 2 AS h FROM pw, (SELECT unnest(range(0, 5)) AS seed) WHERE y = 0) GROUP BY ALL) GROUP BY seed", VEC, POWER))
def spectral_distance_halves(spark, sf):
    p = powers(spark, sf).where("y = 0").crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "seed")))
    h = md5_draw(F.concat_ws(":", "vec_id", "seed"), 2)
    g = p.groupBy("seed", "channel", "w").agg(F.avg(F.when(h == 0, F.col("p"))).alias("a"), F.avg(F.when(h == 1, F.col("p"))).alias("b"))
    return g.groupBy("seed").agg(F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2)) / F.pow(1 + F.col("w"), F.lit(2))).alias("distance"))


RECUR = """walk AS (SELECT vec_id, y, x, 0 AS i, 0.0::DOUBLE AS h, 0.0::DOUBLE AS e FROM vec UNION ALL
 SELECT vec_id, y, x, i + 1, h + 0.3 * (x[i + 1] - h) + 0.2 * (e - h), e + 0.1 * ((h + 0.3 * (x[i + 1] - h) + 0.2 * (e - h)) - e) FROM walk WHERE i < 64)"""
RECURSIVE = "WITH RECURSIVE " + VEC + ", " + RECUR


def outputs(spark, sf):
    return vectors(spark, sf).select("vec_id", "y", K.linear_recurrence(F.col("x"), 0.3, 0.2, 0.1).alias("ys"))


@query(RECURSIVE + " SELECT vec_id, round(h - e, 9) AS last FROM walk WHERE i = 64")
def linear_filter_recurrence(spark, sf):
    return outputs(spark, sf).select("vec_id", F.round(F.element_at("ys", -1), 9).alias("last"))


STRESS = ", stress AS (SELECT vec_id, y, avg(abs(h - e)) FILTER (i > 0) AS stress FROM walk GROUP BY vec_id, y)"


def stress(spark, sf):
    return outputs(spark, sf).select("vec_id", "y", K.mean_of(F.transform("ys", lambda v: F.abs(v))).alias("stress"))


@query(RECURSIVE + STRESS + " SELECT vec_id, round(stress, 9) AS stress FROM stress")
def stress_score(spark, sf):
    return stress(spark, sf).select("vec_id", F.round("stress", 9).alias("stress"))


@query(RECURSIVE + " SELECT quantile_cont(abs(h - e), 0.5) AS tau FROM walk WHERE i > 0 AND y = 0")
def calibrate_median_stress(spark, sf):
    steps = outputs(spark, sf).where("y = 0").select(F.explode("ys").alias("v"))
    return steps.agg(F.percentile(F.abs("v"), 0.5).alias("tau"))


@query(RECURSIVE + STRESS + " SELECT vec_id, round(abs(ln(greatest(stress, 1e-12) / greatest((SELECT median(stress) FROM stress WHERE y = 0), 1e-12))), 9) AS score FROM stress")
def score_two_sided(spark, sf):
    s = stress(spark, sf)
    m = s.where("y = 0").agg(F.percentile("stress", 0.5).alias("m"))
    return s.crossJoin(F.broadcast(m)).select("vec_id", F.round(F.abs(F.log(F.greatest("stress", F.lit(1e-12)) / F.greatest("m", F.lit(1e-12)))), 9).alias("score"))


NORMS = "norms AS (SELECT vec_id, y, t, sqrt(sum(pow(v - before, 2))) AS norm FROM (SELECT vec_id, y, channel, t, v, lag(v) OVER (PARTITION BY vec_id, channel ORDER BY t) AS before FROM pos) WHERE t > 0 GROUP BY vec_id, y, t)"


def norms(spark, sf):
    return vectors(spark, sf).select("vec_id", "y", "x", K.step_norms(F.col("x"), 64, 2).alias("ns"))


@query(with_sql("SELECT vec_id, round(-var_pop(norm), 9) AS score FROM norms GROUP BY vec_id", VEC, POWER, NORMS))
def score_regularity(spark, sf):
    return norms(spark, sf).select("vec_id", F.round(-K.var_pop_of(F.col("ns")), 9).alias("score"))


@query(with_sql("SELECT n.vec_id, round(m / sqrt(v), 9) AS score FROM (SELECT vec_id, avg(norm) AS m FROM norms GROUP BY vec_id) n JOIN (SELECT vec_id, sum(v) AS v FROM (SELECT vec_id, channel, var_pop(v) AS v FROM pos GROUP BY vec_id, channel) GROUP BY vec_id) USING (vec_id)", VEC, POWER, NORMS))
def stationarity_index(spark, sf):
    n = norms(spark, sf)
    spread = K.var_pop_of(channel(0)) + K.var_pop_of(channel(1))
    return n.select("vec_id", F.round(K.mean_of(F.col("ns")) / F.sqrt(spread), 9).alias("score"))


RANKN = "CAST((SELECT count(*) FROM vec r WHERE r.y = 0 AND r.x[1] <= v.x[1]) AS DOUBLE) / (SELECT count(*) FROM vec WHERE y = 0)"


def rank_normalised(rows: DataFrame, value: str, reference: str) -> DataFrame:
    """``rows`` with ecdf: the share of reference rows not above the value."""
    levels = rows.groupBy(value).agg(F.count_if(F.expr(reference)).alias("n"))
    total = levels.agg(F.sum("n").alias("__all"))
    at = running(levels, [], value, ["n"]).crossJoin(F.broadcast(total)).select(value, ((F.col("n_before") + F.col("n")) / F.col("__all")).alias("ecdf"))
    return rows.join(at, value)


@query(with_sql(f"SELECT vec_id, {RANKN} AS ecdf FROM vec v", VEC))
def rank_normalise(spark, sf):
    v = vectors(spark, sf).select("vec_id", "y", F.element_at("x", 1).alias("v"))
    return rank_normalised(v, "v", "y = 0").select("vec_id", "ecdf")


@query(with_sql(f"SELECT vec_id, ({RANKN} + {RANKN.replace('[1]', '[2]')}) / 2 AS score FROM vec v", VEC))
def score_s3(spark, sf):
    v = vectors(spark, sf).select("vec_id", "y", F.element_at("x", 1).alias("a"), F.element_at("x", 2).alias("b"))
    one = rank_normalised(v, "a", "y = 0").select("vec_id", F.col("ecdf").alias("ra"))
    two = rank_normalised(v, "b", "y = 0").select("vec_id", F.col("ecdf").alias("rb"))
    return one.join(two, "vec_id").select("vec_id", ((F.col("ra") + F.col("rb")) / 2).alias("score"))


EXP = "(exp(10 * x[1]) + exp(10 * x[2]) + exp(10 * x[3]))"


def logits():
    return F.array(*[10 * F.element_at("x", i) for i in (1, 2, 3)])


@query(with_sql(f"SELECT vec_id, round(1 - greatest(exp(10 * x[1]), exp(10 * x[2]), exp(10 * x[3])) / {EXP}, 9) AS score FROM vec", VEC))
def score_msp(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(K.msp(logits()), 9).alias("score"))


@query(with_sql(f"SELECT vec_id, round(exp(10 * x[2]) / {EXP}, 9) AS score FROM vec", VEC))
def score_p_attack(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(K.p_attack(logits()), 9).alias("score"))


@query(with_sql(f"SELECT vec_id, round(-ln({EXP}), 9) AS score FROM vec", VEC))
def score_energy(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(K.energy(logits()), 9).alias("score"))


@query(with_sql("SELECT channel, avg(v) AS mean FROM pos WHERE y = 0 GROUP BY channel", VEC, POWER))
def benign_embedding_mean(spark, sf):
    v = vectors(spark, sf).where("y = 0").select(F.posexplode("x").alias("i", "v"))
    return v.groupBy((F.col("i") % 2).alias("channel")).agg(F.avg("v").alias("mean"))


@query(with_sql("""SELECT vec_id, round(-list_sum(list_transform(range(1, 65), lambda i: x[i] * mu[i])), 9) AS score FROM vec, (SELECT list(m / n ORDER BY i) AS mu FROM (SELECT i, m, sqrt(sum(m * m) OVER ()) AS n FROM (SELECT i, sum(x[i] / sqrt(list_sum(list_transform(x, lambda v: v * v)))) AS m FROM vec, (SELECT unnest(range(1, 65)) AS i) WHERE y = 0 GROUP BY i)))""", VEC))
def embed_centroid_score(spark, sf):
    """-z.mu, mu the normalised sum of L2-normalised benign vectors."""
    v = vectors(spark, sf)
    unit = v.where("y = 0").withColumn("n", F.sqrt(K.dot(F.col("x"), F.col("x")))).select(F.posexplode(F.transform("x", lambda a: a / F.col("n"))).alias("i", "v"))
    sums = unit.groupBy("i").agg(F.sum("v").alias("m"))
    mu = sums.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.transform("s", lambda r: r["m"]).alias("mu")).withColumn("norm", F.sqrt(K.dot(F.col("mu"), F.col("mu"))))
    return v.crossJoin(F.broadcast(mu)).select("vec_id", F.round(-K.dot(F.col("x"), F.col("mu")) / F.col("norm"), 9).alias("score"))


SEP = "bat AS (SELECT vec_id, y, vec_id // 50 AS batch, x FROM vec), prs AS (SELECT a.y AS ya, b.y AS yb, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.x[i] - b.x[i], 2)))) AS d FROM bat a JOIN bat b ON a.batch = b.batch AND a.vec_id <> b.vec_id WHERE a.y = 0)"


@query(with_sql("SELECT round(avg(d * d) FILTER (yb = 0) + avg(pow(1 - d, 2)) FILTER (yb = 1), 9) AS separation FROM prs", VEC, SEP))
def embedding_pair_separation(spark, sf):
    """Mean over pairs inside batches of 50 neighbouring ids (a batch bounds the pairs of a row)."""
    v = vectors(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 50))
    a = v.where("y = 0").select("batch", F.col("vec_id").alias("i"), F.col("x").alias("xa"))
    p = a.join(v.select("batch", F.col("vec_id").alias("j"), "y", F.col("x").alias("xb")), "batch").where("i <> j")
    d = F.sqrt(K.total(F.zip_with("xa", "xb", lambda m, n: (m - n) * (m - n))))
    q = p.select("y", d.alias("d"))
    return q.agg(F.round(F.avg(F.when(F.col("y") == 0, F.col("d") * F.col("d"))) + F.avg(F.when(F.col("y") == 1, (1 - F.col("d")) * (1 - F.col("d")))), 9).alias("separation"))


# ---- detectors: rows-only checks here, compared with numpy in the tests ----------------------------------------


def benign(spark, sf):
    return vectors(spark, sf).where("y = 0").select("vec_id", "x")


def probes(spark, sf):
    return vectors(spark, sf).select("vec_id", "x")


def distance_sql(references: str, shrink: str) -> list[str]:
    """CTEs ending in ``far`` (condition, vec_id, score): distances under the inverse of each reference's shrunk covariance, swept row by row.

    ``references`` selects (condition, x); ``shrink`` is an expression over the moments n, mu, beta and delta.
    """
    return [f"refs AS ({references})",
            "centre AS (SELECT condition, i, avg(x[i]) AS m, count(*) AS n FROM refs, (SELECT unnest(range(1, 65)) AS i) GROUP BY condition, i)",
            "centres AS (SELECT condition, list(m ORDER BY i) AS mean FROM centre GROUP BY condition)",
            "apart AS (SELECT r.condition, list_transform(range(1, 65), lambda i: r.x[i] - c.mean[i]) AS d FROM refs r JOIN centres c USING (condition))",
            "spread AS (SELECT condition, i, j, avg(d[i] * d[j]) AS s FROM apart, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY condition, i, j)",
            "level AS (SELECT condition, sum(s) FILTER (i = j) / 64 AS mu, sum(s * s) AS squares FROM spread GROUP BY condition)",
            "fourth AS (SELECT condition, count(*) AS n, avg(pow(list_sum(list_transform(d, lambda e: e * e)), 2)) AS f FROM apart GROUP BY condition)",
            "shape AS (SELECT s.condition, any_value(mu) AS mu, any_value((f - squares) / n) AS beta, sum(pow(s - CASE WHEN i = j THEN mu ELSE 0 END, 2)) AS delta FROM spread s JOIN level USING (condition) JOIN fourth USING (condition) GROUP BY s.condition)",
            f"shrunk AS (SELECT condition, i, j, (1 - a) * s + CASE WHEN i = j THEN a * mu ELSE 0 END AS v FROM spread JOIN (SELECT condition, mu, {shrink} AS a FROM shape) USING (condition))",
            """swept AS (SELECT condition, 1 AS k, i, j, v FROM shrunk UNION ALL
  SELECT a.condition, a.k + 1, a.i, a.j, CASE WHEN a.i = a.k AND a.j = a.k THEN 1 / p.v WHEN a.i = a.k THEN a.v / p.v WHEN a.j = a.k THEN -a.v / p.v ELSE a.v - c.v * r.v / p.v END
  FROM swept a JOIN swept p ON p.condition = a.condition AND p.i = a.k AND p.j = a.k JOIN swept r ON r.condition = a.condition AND r.i = a.k AND r.j = a.j JOIN swept c ON c.condition = a.condition AND c.i = a.i AND c.j = a.k WHERE a.k <= 64)""",
            "precise AS (SELECT condition, i, j, v FROM swept WHERE k = 65)",
            "rows_of AS (SELECT condition, i, list(v ORDER BY j) AS row FROM precise GROUP BY condition, i)",
            "away AS (SELECT condition, vec_id, list_transform(range(1, 65), lambda i: x[i] - mean[i]) AS d FROM vec, centres)",
            "far AS (SELECT condition, vec_id, sqrt(sum(d[i] * list_dot_product(d, row))) AS score FROM away JOIN rows_of USING (condition) GROUP BY condition, vec_id)"]


LEDOIT_WOLF = "least(beta, delta) / delta"
ONE = "SELECT 'one' AS condition, x FROM vec WHERE y = 0"


def recursive(select: str, *parts: str) -> str:
    return with_sql(select, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive("SELECT vec_id, round(score, 6) AS score FROM far", VEC, *distance_sql(ONE, LEDOIT_WOLF)))
def det_mahalanobis(spark, sf):
    return D.mahalanobis(probes(spark, sf), benign(spark, sf)).withColumn("score", F.round("score", 6))


UNIT = "unit AS (SELECT vec_id, y, list_transform(x, lambda e: e / norm) AS u FROM (SELECT *, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM vec))"


@query(with_sql("SELECT p.vec_id, round(list_sort(list(list_distance(p.u, b.u)))[10], 6) AS score FROM unit p, unit b WHERE b.y = 0 GROUP BY p.vec_id", VEC, UNIT))
def det_knn(spark, sf):
    return D.knn(probes(spark, sf), benign(spark, sf), "vec_id").withColumn("score", F.round("score", 6))


@query()
def det_pca_recon(spark, sf):
    return D.pca_reconstruction(probes(spark, sf), benign(spark, sf))


@query()
def det_isolation_forest(spark, sf):
    return D.isolation_forest(probes(spark, sf), benign(spark, sf), "vec_id")


def labelled_half(spark, sf):
    """Even ids to learn from, odd ids to score."""
    v = vectors(spark, sf)
    return v.where("vec_id % 2 = 0").select("x", "y"), v.where("vec_id % 2 = 1").select("vec_id", "x")


@query()
def det_gbt_supervised(spark, sf):
    """300 trees of depth 6, all rows and entries."""
    return B.boosted_trees(*labelled_half(spark, sf))


@query()
def det_gbt_subsampled(spark, sf):
    """The seeded variant: each tree sees 0.8 of the rows and of the entries."""
    return B.boosted_trees(*labelled_half(spark, sf), rows=0.8, columns=0.8)


@query(recursive("SELECT vec_id, round(score, 6) AS score FROM far", VEC, *distance_sql(ONE, "0.1")))
def whitener(spark, sf):
    return D.whitened_norm(probes(spark, sf), benign(spark, sf)).withColumn("score", F.round("score", 6))


@query()
def score_grid(spark, sf):
    """(detector, vec_id, score) of the reference-based detectors."""
    p, b = probes(spark, sf), benign(spark, sf)
    made = {"mahalanobis": D.mahalanobis(p, b), "knn": D.knn(p, b, "vec_id"), "pca": D.pca_reconstruction(p, b), "forest": D.isolation_forest(p, b, "vec_id")}
    parts = [df.select(F.lit(n).alias("detector"), "vec_id", "score") for n, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(recursive("SELECT condition, vec_id, round(score, 6) AS score FROM far", VEC, *distance_sql("SELECT CASE WHEN vec_id % 2 = 0 THEN 'source' ELSE 'anchor' END AS condition, x FROM vec WHERE y = 0", LEDOIT_WOLF)))
def reanchor(spark, sf):
    """Mahalanobis scores under the first and under a second benign reference, by condition."""
    p, b = probes(spark, sf), benign(spark, sf)
    one = D.mahalanobis(p, b.where("vec_id % 2 = 0")).withColumn("condition", F.lit("source"))
    both = one.unionByName(D.mahalanobis(p, b.where("vec_id % 2 = 1")).withColumn("condition", F.lit("anchor")))
    return both.withColumn("score", F.round("score", 6))


GRID = ["shown AS (SELECT 'whole' AS checkpoint, * FROM vec UNION ALL SELECT 'front', vec_id, cls, y, x[1:32] FROM vec)",
        "scaled AS (SELECT *, list_transform(x, lambda e: e / norm) AS u FROM (SELECT *, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM shown))",
        "means AS (SELECT checkpoint, list(m ORDER BY i) AS mean FROM (SELECT checkpoint, i, avg(x[i]) AS m FROM (SELECT checkpoint, x, unnest(range(1, len(x) + 1)) AS i FROM shown WHERE y = 0) GROUP BY ALL) GROUP BY checkpoint)"]
SETS = "CASE WHEN {v}cls < 5 THEN 'benign' WHEN {v}cls < 8 THEN 'near' ELSE 'far' END AS set_name"


@query(with_sql(f"""SELECT checkpoint, 'centroid' AS detector, vec_id, {SETS.format(v='')}, round(list_distance(x, mean), 6) AS score FROM shown JOIN means USING (checkpoint)
 UNION ALL SELECT p.checkpoint, 'knn', p.vec_id, any_value(p.set_name), round(list_sort(list(list_distance(p.u, b.u)))[10], 6) FROM (SELECT *, {SETS.format(v='')} FROM scaled) p JOIN scaled b ON b.checkpoint = p.checkpoint AND b.y = 0 GROUP BY p.checkpoint, p.vec_id""", VEC, *GRID))
def score_grid_sets(spark, sf):
    """Two representations (all entries, the first 32), three evaluation sets, detectors whose scores SQL can express."""
    v = vectors(spark, sf)
    sets = F.when(F.col("cls") < 5, "benign").when(F.col("cls") < 8, "near").otherwise("far")
    made = {"centroid": D.centroid, "knn": lambda p, b: D.knn(p, b, "vec_id")}
    grid = D.score_grid(v.select("vec_id", sets.alias("set_name"), "x"), v.where("y = 0").select("vec_id", "x"), {"whole": F.col("x"), "front": F.slice("x", 1, 32)}, made)
    return grid.withColumn("score", F.round("score", 6))
