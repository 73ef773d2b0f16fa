"""Queries: audits and train-only cleaning of line items (with planted copies, constants, infinities and NaN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltybench.operators import audit as A
from noveltybench.operators import clean as K
from noveltybench.operators import verify as V
from noveltybench.plans.base import kept, millis, query, table, with_sql

COLUMNS = ["quantity", "price", "discount", "tax", "copy", "constant"]
HEAVY = ["price", "quantity"]


@kept("features")
def features(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    price = F.when(F.col("l_orderkey") % 997 == 0, F.lit(float("inf"))).when(F.col("l_partkey") % 991 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_linestatus").alias("side"), F.when(F.col("l_returnflag") == "N", "Benign").otherwise(F.col("l_returnflag")).alias("cls"), millis("l_shipdate").alias("t_ms"), F.col("l_quantity").alias("quantity"), price.alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("copy"), F.lit(1.0).alias("constant"))


FEATURES = """feat AS (SELECT l_orderkey, l_partkey, l_linenumber, l_linestatus AS side, CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE l_returnflag END AS cls, epoch_us(l_shipdate) / 1000.0 AS t_ms, l_quantity AS quantity,
  CASE WHEN l_orderkey % 997 = 0 THEN 'Infinity'::DOUBLE WHEN l_partkey % 991 = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS price, l_discount AS discount, l_tax AS tax, l_quantity AS copy, 1.0::DOUBLE AS constant FROM lineitem)"""


@query("SELECT column_name AS \"column\", CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type, (SELECT count(*) FROM lineitem) AS \"rows\" FROM (DESCRIBE WITH " + FEATURES + " SELECT * FROM feat)")
def audit_shape_types(spark, sf):
    return A.shape_types(features(spark, sf))


@query(with_sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (isnan({c})) AS nan, count(*) FILTER (isinf({c})) AS inf FROM feat" for c in COLUMNS), FEATURES))
def audit_nan_inf(spark, sf):
    return A.nan_inf(features(spark, sf), COLUMNS)


@query(with_sql("SELECT cls AS value, count(*) AS n FROM feat GROUP BY cls", FEATURES))
def audit_value_counts(spark, sf):
    return A.value_counts(features(spark, sf), "cls")


@query(with_sql("SELECT count(*) FILTER ((CAST(side = 'F' AS INTEGER) = 0) <> (cls = 'Benign')) AS inconsistent FROM feat", FEATURES))
def audit_label_consistency(spark, sf):
    return A.label_consistency(features(spark, sf).withColumn("label", (F.col("side") == "F").cast("int")), "label", "cls")


@query(with_sql("SELECT min(t_ms) AS first, max(t_ms) AS last, (max(t_ms) - min(t_ms)) / 3600000.0 AS span_hours, CAST(0 AS BIGINT) AS nan FROM feat", FEATURES))
def audit_time_range(spark, sf):
    return A.time_range(features(spark, sf), "t_ms")


@query("SELECT CAST(count(*) AS BIGINT) AS falls, count(*) = 0 AS is_sorted FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events) WHERE before > ts")
def audit_sorted_in_file(spark, sf):
    e = table(spark, sf, "events").select("event_id", millis("ts").alias("t"))
    return A.sorted_by_id(e, "t", "event_id", 1000)


@query(with_sql("SELECT count(*) FILTER (t_ms + 86400000.0 * (discount * 100 - 5) < t_ms) AS end_before_start FROM feat", FEATURES))
def audit_end_before_start(spark, sf):
    f = features(spark, sf).withColumn("end", F.col("t_ms") + 86_400_000.0 * (F.col("discount") * 100 - 5))
    return A.end_before_start(f, "t_ms", "end")


SEGMENTS = "seg AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1)"
PUBLISHED = "pub AS (SELECT CASE WHEN value = 'MACHINERY' THEN 'Machinery' ELSE value END AS value, CASE WHEN value = 'BUILDING' THEN n + 1 ELSE n END AS n FROM seg WHERE value <> 'FURNITURE' UNION ALL SELECT 'UNKNOWN', 3)"


def segments(spark, sf):
    return A.value_counts(table(spark, sf, "customer"), "c_mktsegment")


def published(spark, sf):
    """Published counts with one edited row, one case change, one row missing and one added."""
    s = segments(spark, sf).where("value <> 'FURNITURE'")
    edited = s.select(F.when(F.col("value") == "MACHINERY", "Machinery").otherwise(F.col("value")).alias("value"), (F.col("n") + (F.col("value") == "BUILDING").cast("long")).alias("n"))
    return edited.unionByName(spark.createDataFrame([("UNKNOWN", 3)], "value string, n long"))


@query(with_sql("""SELECT coalesce(s.value, p.value) AS name, s.n AS file_n, p.n AS published_n, CASE WHEN s.value IS NULL THEN 'missing' WHEN p.value IS NULL THEN 'extra' WHEN s.n <> p.n THEN 'count differs' WHEN s.value <> p.value THEN 'case differs' ELSE 'match' END AS status
 FROM seg s FULL OUTER JOIN pub p ON lower(s.value) = lower(p.value)""", SEGMENTS, PUBLISHED))
def reconcile_published_counts(spark, sf):
    return A.reconcile(segments(spark, sf), published(spark, sf))


@query(with_sql("SELECT 'class_map' AS check_name, CAST((SELECT count(*) FROM seg WHERE value NOT IN (SELECT value FROM pub)) + (SELECT count(*) FROM pub WHERE value NOT IN (SELECT value FROM seg)) AS BIGINT) AS violations, FALSE AS ok", SEGMENTS, PUBLISHED))
def validate_class_map(spark, sf):
    """Names on either side only."""
    a, b = segments(spark, sf).select("value"), published(spark, sf).select("value")
    return V.check(a.join(b, "value", "left_anti").unionByName(b.join(a, "value", "left_anti")), "class_map")


# ---- cleaning: train rows have an even order key --------------------------------------------------------------

TRAIN = "train AS (SELECT * FROM feat WHERE l_orderkey % 2 = 0)"


def stats_sql(source: str, out: str) -> str:
    medians = ", ".join(f"coalesce(median({c}) FILTER (isfinite({c})), 0) AS m_{c}, min({c}) FILTER (isfinite({c})) AS lo_{c}" for c in COLUMNS)
    values = ", ".join(f"(m_{c} >= 0 AND coalesce(lo_{c}, m_{c}) >= 0 AND {str(c in HEAVY).upper()}) AS lg_{c}, CASE WHEN isfinite({c}) THEN {c} ELSE m_{c} END AS v_{c}, m_{c}" for c in COLUMNS)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS place, '{c}' AS feature, max(m_{c}) AS median, bool_or(lg_{c}) AS log1p, avg(CASE WHEN lg_{c} THEN ln(1 + greatest(v_{c}, 0)) ELSE v_{c} END) AS mean, stddev_pop(CASE WHEN lg_{c} THEN ln(1 + greatest(v_{c}, 0)) ELSE v_{c} END) AS std FROM {out}_v" for i, c in enumerate(COLUMNS)
    )
    return f"{out}_m AS (SELECT {medians} FROM {source}), {out}_v AS (SELECT {values} FROM {source}, {out}_m), {out}_r AS ({rows}), {out} AS (SELECT *, CASE WHEN std <= 1e-12 THEN 'zero variance' END AS dropped FROM {out}_r)"


PARAMS = stats_sql("train", "params")


def train(spark, sf):
    return features(spark, sf).where("l_orderkey % 2 = 0")


@kept("params")
def params(spark, sf):
    return K.fit(train(spark, sf), COLUMNS, HEAVY)


@query(with_sql("SELECT feature, median FROM params", FEATURES, TRAIN, PARAMS))
def clean_fit_median(spark, sf):
    return params(spark, sf).select("feature", "median")


@query(with_sql("SELECT feature, log1p FROM params", FEATURES, TRAIN, PARAMS))
def clean_log1p_select(spark, sf):
    return params(spark, sf).select("feature", "log1p")


@query(with_sql("SELECT feature, dropped FROM params WHERE dropped IS NOT NULL", FEATURES, TRAIN, PARAMS))
def clean_zero_variance(spark, sf):
    return params(spark, sf).where("dropped is not null").select("feature", "dropped")


@query(with_sql("SELECT feature, mean, std FROM params", FEATURES, TRAIN, PARAMS))
def clean_mean_std(spark, sf):
    return params(spark, sf).select("feature", "mean", "std")


@query(with_sql("SELECT count(*) FILTER (NOT isfinite(price)) AS imputed, avg(CASE WHEN isfinite(price) THEN price ELSE (SELECT median FROM params WHERE feature = 'price') END) AS mean_price FROM feat", FEATURES, TRAIN, PARAMS))
def clean_impute(spark, sf):
    median = params(spark, sf).where("feature = 'price'").select("median")
    f = features(spark, sf).crossJoin(F.broadcast(median))
    return f.agg(F.count_if(A.finite("price").isNull()).alias("imputed"), F.avg(F.coalesce(A.finite("price"), F.col("median"))).alias("mean_price"))


@query(with_sql("SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN isfinite(price) THEN price END AS price FROM feat WHERE NOT isfinite(price) OR price > 100000", FEATURES))
def filter_finite(spark, sf):
    f = features(spark, sf).where(F.isnan("price") | (F.abs("price") == float("inf")) | (F.col("price") > 100000))
    return f.select("l_orderkey", "l_partkey", "l_linenumber", A.finite("price").alias("price"))


PAIRS = ["quantity", "discount", "tax", "copy"]
CORR = "corrs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM train" for i, a in enumerate(PAIRS) for b in PAIRS[i + 1 :]) + ")"


@query(with_sql("SELECT a, b, r FROM corrs", FEATURES, TRAIN, CORR))
def clean_corr_matrix(spark, sf):
    return K.correlation_pairs(train(spark, sf), PAIRS)


@query(with_sql("SELECT b AS dropped, a AS repeats FROM corrs WHERE abs(r) >= 0.999999", FEATURES, TRAIN, CORR))
def clean_corr_prune(spark, sf):
    pairs = [tuple(r) for r in K.correlation_pairs(train(spark, sf), PAIRS).collect()]  # a few numbers a column
    return spark.createDataFrame(list(K.correlation_prune(pairs, PAIRS).items()), "dropped string, repeats string")


def _clean_sql(c: str) -> str:
    x = f"CASE WHEN isfinite({c}) THEN {c} ELSE (SELECT median FROM params WHERE feature = '{c}') END"
    x = f"CASE WHEN (SELECT log1p FROM params WHERE feature = '{c}') THEN ln(1 + greatest({x}, 0)) ELSE {x} END"
    return f"round(({x} - (SELECT mean FROM params WHERE feature = '{c}')) / (SELECT std FROM params WHERE feature = '{c}'), 5) AS {c}"


KEPT = ["quantity", "price", "discount", "tax"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 5).alias(c) if c in KEPT else F.col(c) for c in df.columns])


@query(with_sql("SELECT l_orderkey, l_partkey, l_linenumber, side, cls, " + ", ".join(map(_clean_sql, KEPT)) + " FROM feat", FEATURES, TRAIN, PARAMS))
def clean_transform(spark, sf):
    p = [r.asDict() for r in params(spark, sf).collect()]  # one row a feature
    return _rounded(K.transform(features(spark, sf).drop("t_ms"), p, KEPT))


@query(with_sql("SELECT feature FROM pf JOIN po USING (feature) WHERE pf.dropped IS NULL AND po.dropped IS NULL", FEATURES, "tf AS (SELECT * FROM feat WHERE side = 'F')", stats_sql("tf", "pf"), "tn AS (SELECT * FROM feat WHERE side = 'O')", stats_sql("tn", "po")))
def common_features(spark, sf):
    f = features(spark, sf)
    return K.common_features([K.fit(f.where(F.col("side") == s), COLUMNS, HEAVY) for s in ("F", "O")])


@query(with_sql("SELECT l_orderkey, l_partkey, l_linenumber, " + ", ".join(map(_clean_sql, KEPT)) + " FROM feat WHERE side = 'O'", FEATURES, "train AS (SELECT * FROM feat WHERE side = 'F')", PARAMS))
def transfer_package(spark, sf):
    """Target rows under the source's cleaner: nothing is fitted on the target."""
    f = features(spark, sf)
    p = [r.asDict() for r in K.fit(f.where("side = 'F'"), COLUMNS, HEAVY).collect()]
    return _rounded(K.transform(f.where("side = 'O'").drop("t_ms", "side", "cls"), p, KEPT))


@query(with_sql("SELECT 'flows_finite' AS check_name, count(*) FILTER (NOT isfinite(price)) AS violations, count(*) FILTER (NOT isfinite(price)) = 0 AS ok FROM feat", FEATURES))
def verify_flows_finite(spark, sf):
    return V.check(features(spark, sf).where(A.finite("price").isNull()), "flows_finite")


def _far_sql(c: str) -> str:
    scale = "least(greatest(abs(a.mean), a.std), greatest(abs(b.mean), b.std))"
    return f"(a.{c} IS DISTINCT FROM b.{c} AND NOT coalesce(abs(a.{c} - b.{c}) <= 1e-9 * {scale}, FALSE))"


DIFFERING = " OR ".join([*[f"a.{c} IS DISTINCT FROM b.{c}" for c in ("place", "median", "log1p", "dropped")], *map(_far_sql, ("mean", "std"))])


@query(with_sql(f"SELECT 'transfer_cleaner' AS check_name, count(*) AS violations, count(*) = 0 AS ok FROM params a FULL OUTER JOIN po b USING (feature) WHERE {DIFFERING}", FEATURES, TRAIN, PARAMS, "tn AS (SELECT * FROM feat WHERE side = 'O')", stats_sql("tn", "po")))
def verify_transfer_cleaner(spark, sf):
    """A cleaner refitted on other rows must not pass for the source's, whichever of its parameters differs."""
    other = K.fit(features(spark, sf).where("side = 'O'"), COLUMNS, HEAVY)
    return V.check(K.differing(params(spark, sf), other), "transfer_cleaner")


@query(with_sql("SELECT 'frozen_features' AS check_name, count(*) AS violations, count(*) = 0 AS ok FROM (SELECT feature FROM params WHERE dropped IS NULL) a FULL OUTER JOIN (SELECT unnest(['quantity', 'price', 'discount', 'tax']) AS feature) b USING (feature) WHERE a.feature IS NULL OR b.feature IS NULL", FEATURES, TRAIN, PARAMS))
def verify_frozen_features(spark, sf):
    frozen = spark.createDataFrame([(c,) for c in KEPT], "feature string").withColumn("__f", F.lit(True))
    found = params(spark, sf).where("dropped is null").select("feature").withColumn("__p", F.lit(True))
    return V.check(found.join(frozen, "feature", "full_outer").where("__f is null or __p is null"), "frozen_features")


@query(with_sql("SELECT l_orderkey, l_linenumber, quantity, discount, tax FROM feat", FEATURES))
def project_numeric_only(spark, sf):
    f = features(spark, sf).drop("price", "copy", "constant", "t_ms", "l_partkey")
    return f.select(*[c for c, kind in f.dtypes if kind in ("double", "int", "bigint")])


@query(with_sql("SELECT quantity, CASE WHEN isfinite(price) THEN price END AS price, discount, tax, cls FROM feat", FEATURES))
def project_drop_roles(spark, sf):
    roles = {"l_orderkey": "identifier", "l_partkey": "identifier", "l_linenumber": "identifier", "t_ms": "timestamp", "side": "internal", "copy": "internal", "constant": "internal"}
    return features(spark, sf).withColumn("price", A.finite("price")).drop(*roles)


@query("SELECT l_orderkey AS row_id, epoch_us(l_shipdate) / 1000.0 AS t_ms, l_returnflag AS attack, CAST(l_returnflag <> 'N' AS INTEGER) AS label, l_quantity AS quantity FROM lineitem")
def rename_adapter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity")
    named = li.withColumnsRenamed({"l_orderkey": "row_id", "l_returnflag": "attack", "l_quantity": "quantity"})
    return named.select("row_id", millis("l_shipdate").alias("t_ms"), "attack", (F.col("attack") != "N").cast("int").alias("label"), "quantity")


@query("SELECT l_returnflag AS cls, count(*) AS n FROM lineitem GROUP BY 1")
def guard_unlabelled(spark, sf):
    li = table(spark, sf, "lineitem")
    cls = F.when(F.col("l_returnflag") == "NeedManualLabel", F.raise_error(F.lit("a sentinel label remains")).cast("string")).otherwise(F.col("l_returnflag"))
    return li.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("""SELECT 'quantity' AS feature, (SELECT sum(abs(fa / na - fb / nb) * gap) FROM (SELECT v, lead(v) OVER (ORDER BY v) - v AS gap, sum(a) OVER (ORDER BY v) AS fa, sum(b) OVER (ORDER BY v) AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb
 FROM (SELECT quantity AS v, (count(*) FILTER (side = 'F'))::DOUBLE AS a, (count(*) FILTER (side = 'O'))::DOUBLE AS b FROM feat GROUP BY quantity))) AS distance""", FEATURES))
def wasserstein_1d(spark, sf):
    from noveltybench.operators.scores import wasserstein_1d as w1

    return w1(features(spark, sf).select(F.lit("quantity").alias("feature"), F.col("quantity").alias("v"), (F.col("side") == "F").alias("first")))
