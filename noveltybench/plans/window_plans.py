"""Queries: blocks, windows, labels, duplicates, splits, samples and folds of the flow fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltybench.functions.sampling import md5_order
from noveltybench.operators import splits as S
from noveltybench.operators import verify as V
from noveltybench.operators import windows as W
from noveltybench.plans.base import BLOCK_MS, PLACED, SEED, SIZE, SPLIT_GAP, SPLIT_RANDOM, STRIDE, balance_sql, flows, kept, query, windowed

FAMILIES = {"Benign": ["Benign"], "Fault": ["error", "late"], "Sale": ["purchase"]}


def numbered(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    return W.numbered(W.class_codes(W.time_blocks(flows(spark, sf, late), BLOCK_MS)))


def exploded(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    return W.count_windows(numbered(spark, sf, late), SIZE, STRIDE)


@kept("windows")
def windows(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    """Labelled windows with window_id."""
    return W.window_labels(exploded(spark, sf, late), SIZE).withColumn("window_id", F.col("grp").cast("long") * F.lit(4294967296) + F.col("k"))


@kept("placed")
def placed(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    """Windows with their temporal-gap split."""
    w = windows(spark, sf, late)
    return S.with_split(w, S.split_temporal_gap(w))


def classes(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    return W.class_table(flows(spark, sf, late))


@query(windowed("SELECT row_id, t_ms, CAST(row_number() OVER (ORDER BY t_ms, row_id) AS BIGINT) AS place FROM flows"))
def sort_by_time(spark, sf):
    """All flows with their place in time order."""
    return W.placed_by_time(flows(spark, sf)).select("row_id", "t_ms", "place")


@query(windowed("SELECT row_id, grp, block FROM timed"))
def time_blocks(spark, sf):
    return W.time_blocks(flows(spark, sf), BLOCK_MS).select("row_id", "grp", "block")


@query(windowed("SELECT row_id, code FROM numbered"))
def class_codes(spark, sf):
    return W.class_codes(flows(spark, sf)).select("row_id", "code")


@query(windowed("SELECT f.row_id, c.cls AS label, c.code FROM flows f JOIN codes c USING (cls) WHERE c.code > 0"))
def label_lookup(spark, sf):
    return flows(spark, sf).join(F.broadcast(classes(spark, sf)), "cls").where("code > 0").select("row_id", F.col("cls").alias("label"), "code")


@query(windowed("SELECT grp, CAST(k AS BIGINT) AS k, pos, row_id FROM exploded"))
def count_windows(spark, sf):
    return exploded(spark, sf).select("grp", F.col("k").cast("long").alias("k"), "pos", "row_id")


@query(windowed("""SELECT CAST(sum(CASE WHEN m >= 4 THEN m - (((m - 4) // 2) * 2 + 4) ELSE m END) AS BIGINT) AS flows_in_no_window, count(*) AS groups,
  CAST(sum(CASE WHEN m < 4 THEN 1 ELSE 0 END) AS BIGINT) AS short_groups, CAST(sum(CASE WHEN m >= 4 THEN (m - 4) // 2 + 1 ELSE 0 END) AS BIGINT) AS windows FROM sizes"""))
def window_stats(spark, sf):
    return W.window_stats(numbered(spark, sf), SIZE, STRIDE)


@query(windowed("SELECT y_bin, count(*) AS windows FROM labels GROUP BY y_bin"))
def window_label_bin(spark, sf):
    return windows(spark, sf).groupBy("y_bin").agg(F.count(F.lit(1)).alias("windows"))


@query(windowed("SELECT grp, k, start_rn, y_bin, y_cls FROM labels"))
def window_label_majority(spark, sf):
    return windows(spark, sf).select("grp", "k", "start_rn", "y_bin", "y_cls")


@query(windowed("SELECT grp, count(*) AS windows, count(*) FILTER (n_modes > 1) AS tied FROM labels GROUP BY grp"))
def window_majority_ties(spark, sf):
    return windows(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("n_modes") > 1).alias("tied"))


@query(windowed("SELECT grp, k, purity FROM labels"))
def window_purity(spark, sf):
    return windows(spark, sf).select("grp", "k", "purity")


@query(windowed("SELECT grp, k, CAST(code // 64 AS INTEGER) AS word, CAST(bit_or(CAST(1 AS BIGINT) << (code % 64)) AS BIGINT) AS class_mask FROM percls GROUP BY ALL"))
def window_class_mask(spark, sf):
    """One row a word of a window's class bitset."""
    return windows(spark, sf).select("grp", "k", F.posexplode("class_mask").alias("word", "class_mask"))


@query(windowed("SELECT grp, k, n_attack FROM labels"))
def window_n_attack(spark, sf):
    return windows(spark, sf).select("grp", "k", "n_attack")


@query(windowed("SELECT grp, k, CAST(code // 64 AS INTEGER) AS word, CAST(bit_or(CAST(1 AS BIGINT) << (code % 64)) AS BIGINT) AS class_mask FROM percls p WHERE EXISTS (SELECT 1 FROM percls x JOIN codes c USING (code) WHERE x.grp = p.grp AND x.k = p.k AND c.cls = 'error') GROUP BY ALL"))
def filter_mask_contains(spark, sf):
    error = classes(spark, sf).where("cls = 'error'").select(F.col("code").alias("__c"))
    w = windows(spark, sf).crossJoin(F.broadcast(error))
    return w.where(S.has_class("class_mask", F.col("__c"))).select("grp", "k", F.posexplode("class_mask").alias("word", "class_mask"))


@query(windowed("SELECT w.window_id, w.grp FROM win w WHERE grp IN (SELECT grp FROM (SELECT grp, count(*) AS n FROM win GROUP BY grp) WHERE n % 2 = 0)"))
def filter_isin_groups(spark, sf):
    w = windows(spark, sf)
    return w.join(S.group_sizes(w).where("n % 2 = 0"), "grp", "left_semi").select("window_id", "grp")


FAMILY = """fam AS (
  SELECT cls, CASE cls WHEN 'Benign' THEN 'Benign' WHEN 'purchase' THEN 'Sale' ELSE 'Fault' END AS family FROM codes
), famcodes AS (
  SELECT family, CAST(CASE WHEN family = 'Benign' THEN 0 ELSE row_number() OVER (PARTITION BY family = 'Benign' ORDER BY family) END AS INTEGER) AS family_code FROM (SELECT DISTINCT family FROM fam)
)"""


@query(windowed("SELECT family, family_code, count(*) AS flows FROM flows JOIN fam USING (cls) JOIN famcodes USING (family) GROUP BY ALL", FAMILY, late=True))
def family_codes(spark, sf):
    return W.family_codes(flows(spark, sf, True), FAMILIES).groupBy("family", "family_code").agg(F.count(F.lit(1)).alias("flows"))


@query(windowed("""SELECT grp, CAST(k AS BIGINT) AS k, CAST(max(CASE WHEN code > 0 THEN 1 ELSE 0 END) AS INTEGER) AS y_bin,
  CAST(coalesce(min(family_code) FILTER (family_code > 0 AND n = top), 0) AS INTEGER) AS y_cls FROM (
  SELECT grp, k, family_code, count(*) AS n, max(code) AS code, max(count(*) FILTER (family_code > 0)) OVER (PARTITION BY grp, k) AS top
  FROM exploded JOIN fam USING (cls) JOIN famcodes USING (family) GROUP BY grp, k, family_code) GROUP BY grp, k""", FAMILY, late=True))
def relabel_family(spark, sf):
    coded = W.family_codes(numbered(spark, sf, True), FAMILIES)
    return W.relabel_family(W.count_windows(coded, SIZE, STRIDE), SIZE).select("grp", "k", "y_bin", "y_cls")


HASHED = "hashed AS (SELECT grp, CAST(k AS BIGINT) AS k, sha256(string_agg(CAST(code AS VARCHAR), ';' ORDER BY pos)) AS sha FROM exploded GROUP BY grp, k)"
DEDUPED = "deduped AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY sha ORDER BY grp, k) = 1)"


@kept("hashed")
def hashed(spark, sf):
    return W.window_hashes(exploded(spark, sf), ["code"])


@query(windowed("SELECT grp, k, sha FROM hashed", HASHED))
def window_hash(spark, sf):
    return hashed(spark, sf)


@query(windowed("SELECT grp, k, sha FROM deduped", HASHED, DEDUPED))
def dedupe_windows(spark, sf):
    return W.dedupe_windows(hashed(spark, sf))


@query(windowed("""SELECT count(*) AS conflicts FROM (SELECT y_bin, lag(y_bin) OVER (PARTITION BY sha ORDER BY grp, k) AS before FROM (
  SELECT grp, CAST(k AS BIGINT) AS k, sha256(string_agg(CAST(f2 > 50 AS VARCHAR), ';' ORDER BY pos)) AS sha FROM exploded GROUP BY grp, k) JOIN labels USING (grp, k)) WHERE before <> y_bin"""))
def dedupe_label_conflicts(spark, sf):
    e = exploded(spark, sf).withColumn("high", F.col("f2") > 50)
    return W.dedupe_label_conflicts(W.window_hashes(e, ["high"]).join(W.window_labels(e, SIZE), ["grp", "k"]))


@query(windowed("SELECT grp, CAST(k AS BIGINT) AS k, pos, row_id, f1, f2 FROM exploded JOIN (SELECT grp, k FROM labels WHERE n_attack >= 3) USING (grp, k)"))
def materialize_windows(spark, sf):
    chosen = windows(spark, sf).where("n_attack >= 3")
    return W.materialize_windows(chosen, numbered(spark, sf), SIZE, STRIDE).select("grp", "k", "pos", "row_id", "f1", "f2")


# ---- splits -------------------------------------------------------------------------------------------------


@query(windowed("SELECT grp, count(*) AS n FROM win GROUP BY grp"))
def group_sizes(spark, sf):
    return S.group_sizes(windows(spark, sf))


@query(windowed("SELECT grp, n, split FROM split", SPLIT_GAP))
def split_temporal_gap(spark, sf):
    return S.split_temporal_gap(windows(spark, sf))


@query(windowed("SELECT grp, n, split FROM split", SPLIT_RANDOM))
def split_grouped_random(spark, sf):
    return S.split_grouped_random(windows(spark, sf), SEED)


@query(windowed("SELECT split, CAST(sum(n) AS BIGINT) AS windows FROM split WHERE split <> 'gap' GROUP BY split", SPLIT_GAP))
def split_empty_guard(spark, sf):
    return S.split_empty_guard(S.split_temporal_gap(windows(spark, sf)))


COMPOSITION = """SELECT y_cls, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'gap') AS gap, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test,
  count(*) FILTER (split = 'test') > 0 AND count(*) FILTER (split = 'train') = 0 AS test_only, count(*) FILTER (split = 'val') > 0 AND count(*) FILTER (split = 'train') = 0 AS val_only FROM placed GROUP BY y_cls"""


@query(windowed(COMPOSITION, SPLIT_GAP, PLACED, late=True))
def split_composition(spark, sf):
    return S.split_composition(placed(spark, sf, True))


@query(windowed("SELECT window_id, y_bin FROM picked", SPLIT_GAP, PLACED, "src AS (SELECT * FROM placed WHERE split = 'train')", balance_sql("src", "picked", 1, 14000)))
def balance_exact_ratio(spark, sf):
    return S.balance_exact_ratio(placed(spark, sf).where("split = 'train'"), 1, 14000, SEED).select("window_id", "y_bin")


@query(windowed("SELECT window_id, y_bin FROM placed WHERE split = 'test' ORDER BY md5(window_id || ':17'), window_id LIMIT 20000", SPLIT_GAP, PLACED))
def natural_prior_sample(spark, sf):
    return S.natural_prior_sample(placed(spark, sf).where("split = 'test'"), 20000, SEED).select("window_id", "y_bin")


SETS = [SPLIT_GAP, PLACED, "s_train AS (SELECT * FROM placed WHERE split = 'train')", balance_sql("s_train", "b_train", 1, 14000), "s_val AS (SELECT * FROM placed WHERE split = 'val')", balance_sql("s_val", "b_val", 5, 3000),
        "s_test AS (SELECT * FROM placed WHERE split = 'test')", balance_sql("s_test", "b_test", 5, 3000), "nat AS (SELECT * FROM s_test ORDER BY md5(window_id || ':17'), window_id LIMIT 20000)",
        """sets AS (SELECT 'train' AS set_name, window_id, y_bin FROM b_train UNION ALL SELECT 'val', window_id, y_bin FROM b_val UNION ALL SELECT 'test', window_id, y_bin FROM b_test UNION ALL SELECT 'test_natural', window_id, y_bin FROM nat)"""]


@query(windowed("SELECT set_name, window_id, y_bin FROM sets", *SETS))
def make_sets(spark, sf):
    return S.make_sets(placed(spark, sf), SEED)


@query(windowed("SELECT set_name, n, limited_by FROM (SELECT set_name, count(*) AS n, CASE set_name WHEN 'train' THEN 14000 WHEN 'test_natural' THEN 20000 ELSE 3000 END AS cap, CASE WHEN set_name = 'test_natural' THEN 'rows' WHEN count(*) FILTER (y_bin = 1) = any_value(a) THEN 'attack' ELSE 'benign' END AS limited_by FROM sets JOIN (SELECT split, count(*) FILTER (y_bin = 1) AS a FROM placed GROUP BY split) c ON c.split = replace(set_name, '_natural', '') GROUP BY set_name) WHERE n < cap", *SETS))
def set_below_cap(spark, sf):
    """Sets smaller than their cap and the side that limits them."""
    p = placed(spark, sf)
    sizes = S.make_sets(p, SEED).groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_bin") == 1).alias("attacks"))
    there = p.groupBy("split").agg(F.count_if(F.col("y_bin") == 1).alias("a"))
    cap = F.when(F.col("set_name") == "train", 14000).when(F.col("set_name") == "test_natural", 20000).otherwise(3000)
    joined = sizes.withColumn("split", F.replace("set_name", F.lit("_natural"), F.lit(""))).join(there, "split")
    side = F.when(F.col("set_name") == "test_natural", "rows").when(F.col("attacks") == F.col("a"), "attack").otherwise("benign")
    return joined.where(F.col("n") < cap).select("set_name", "n", side.alias("limited_by"))


FOLDS = [SPLIT_GAP, PLACED, "attack AS (SELECT code AS fold FROM codes WHERE code > 0)",
         "enough AS (SELECT fold FROM placed, attack WHERE split = 'train' AND (class_mask & (1 << fold)) <> 0 GROUP BY fold HAVING count(*) >= 200)",
         "spread AS (SELECT * FROM placed, enough WHERE split <> 'gap' AND CASE WHEN split = 'test' THEN y_bin = 0 OR y_cls = fold ELSE (class_mask & (1 << fold)) = 0 END)",
         "ftr AS (SELECT * FROM spread WHERE split = 'train')", balance_sql("ftr", "btr", 1, 14000, "fold, split"), "fev AS (SELECT * FROM spread WHERE split <> 'train')", balance_sql("fev", "bev", 5, 3000, "fold, split"),
         "folds AS (SELECT fold, split AS part, window_id, y_bin FROM btr UNION ALL SELECT fold, split, window_id, y_bin FROM bev)"]


@kept("folds")
def folds(spark, sf):
    return S.loaco_folds(placed(spark, sf), classes(spark, sf), SEED)


@query(windowed("SELECT fold, part, window_id, y_bin FROM folds", *FOLDS))
def loaco_folds(spark, sf):
    return folds(spark, sf)


FEASIBLE = """SELECT code AS fold, count(part) FILTER (part = 'train') AS train, count(part) FILTER (part = 'val') AS val, count(part) FILTER (part = 'test') AS test,
 count(part) FILTER (part = 'train') > 0 AND count(part) FILTER (part = 'val') > 0 AND count(part) FILTER (part = 'test') > 0 AS feasible FROM codes LEFT JOIN folds ON fold = code WHERE code > 0 GROUP BY code"""


@query(windowed(FEASIBLE, *FOLDS))
def feasibility_table(spark, sf):
    return S.loaco_feasibility(folds(spark, sf), classes(spark, sf))


@query(windowed("SELECT fold, n_test, n_test >= 50 AS feasible, CASE WHEN n_test < 50 THEN 'fewer than 50 test windows' ELSE 'ok' END AS reason FROM (SELECT code AS fold, count(part) FILTER (part = 'test') AS n_test FROM codes LEFT JOIN folds ON fold = code WHERE code > 0 GROUP BY code)", *FOLDS))
def fold_min_test(spark, sf):
    f = S.loaco_feasibility(folds(spark, sf), classes(spark, sf))
    return f.select("fold", F.col("test").alias("n_test"), (F.col("test") >= 50).alias("feasible"), F.when(F.col("test") < 50, "fewer than 50 test windows").otherwise("ok").alias("reason"))


@query(windowed("SELECT count(*) FILTER (feasible) AS feasible_folds, count(*) FILTER (feasible) < 3 AS fallback FROM (" + FEASIBLE + ")", *FOLDS))
def fallback_decision(spark, sf):
    f = S.loaco_feasibility(folds(spark, sf), classes(spark, sf))
    return f.agg(F.count_if("feasible").alias("feasible_folds")).withColumn("fallback", F.col("feasible_folds") < 3)


@query(windowed("SELECT count(*) FILTER (y_bin = 0) AS benign_windows, count(*) FILTER (y_bin = 0) >= 200 AS allowed FROM win"))
def fold_allowed_by_benign(spark, sf):
    return windows(spark, sf).agg(F.count_if(F.col("y_bin") == 0).alias("benign_windows")).withColumn("allowed", F.col("benign_windows") >= 200)


NOVEL = "novel AS (SELECT code, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test' AND y_cls = code) AS n_test FROM placed, codes WHERE code > 0 AND (class_mask & (1 << code)) <> 0 GROUP BY code HAVING count(*) FILTER (split = 'train') = 0 AND count(*) FILTER (split = 'test' AND y_cls = code) > 0)"


@query(windowed("SELECT *, CASE WHEN n_test >= 20 THEN 'novel' ELSE 'near' END AS status FROM novel", SPLIT_GAP, PLACED, NOVEL, late=True))
def nn_class_discovery(spark, sf):
    return S.nn_class_discovery(placed(spark, sf, True), classes(spark, sf, True))


NOVELTY = [SPLIT_GAP, PLACED, NOVEL, "masked AS (SELECT coalesce(sum(1 << code), 0) AS m FROM novel)", "clean AS (SELECT p.* FROM placed p, masked WHERE (class_mask & CAST(m AS BIGINT)) = 0)",
           "n_train AS (SELECT * FROM clean WHERE split = 'train')", balance_sql("n_train", "nb_train", 1, 14000), "n_val AS (SELECT * FROM clean WHERE split = 'val')", balance_sql("n_val", "nb_val", 5, 3000),
           "n_test AS (SELECT p.*, n.code AS cls FROM placed p, novel n WHERE split = 'test' AND (y_bin = 0 OR y_cls = n.code))", balance_sql("n_test", "nb_test", 5, 3000, "cls"),
           "novelty AS (SELECT 'train' AS part, 0 AS cls, window_id, y_bin FROM nb_train UNION ALL SELECT 'val', 0, window_id, y_bin FROM nb_val UNION ALL SELECT 'test', cls, window_id, y_bin FROM nb_test)"]


@kept("novelty")
def novelty(spark, sf):
    p = placed(spark, sf, True)
    return S.natural_novelty_sets(p, S.nn_class_discovery(p, classes(spark, sf, True)), SEED)


@query(windowed("SELECT part, cls, window_id, y_bin FROM novelty", *NOVELTY, late=True))
def natural_novelty_sets(spark, sf):
    return novelty(spark, sf)


CUTS = [0.4, 0.6, 0.8]
ROLLING = """cuts AS (SELECT unnest([0.4, 0.6, 0.8])::DOUBLE AS cut), gs AS (SELECT grp, count(*) AS n FROM win GROUP BY grp), rc AS (
  SELECT cut, grp, n, coalesce(sum(n) OVER (PARTITION BY cut ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < cut * sum(n) OVER (PARTITION BY cut) AS tr FROM gs, cuts
), rolling AS (SELECT cut, grp, n, CASE WHEN tr THEN 'train' WHEN sum(CASE WHEN tr THEN 0 ELSE 1 END) OVER (PARTITION BY cut ORDER BY grp) = 1 THEN 'gap' ELSE 'test' END AS split FROM rc)"""


@query(windowed("SELECT cut, grp, n, split FROM rolling", ROLLING))
def rolling_cut_split(spark, sf):
    return S.rolling_cut_split(windows(spark, sf), CUTS)


@query(windowed("""SELECT s.*, CAST(coalesce(novel, 0) AS BIGINT) AS novel, CAST(coalesce(near, 0) AS BIGINT) AS near, coalesce(novel, 0) > 0 AND train_benign > 0 AND train_attack > 0 AND test_benign > 0 AS feasible FROM (
  SELECT cut, count(*) FILTER (split = 'train' AND y_bin = 0) AS train_benign, count(*) FILTER (split = 'train' AND y_bin = 1) AS train_attack, count(*) FILTER (split = 'test' AND y_bin = 0) AS test_benign, count(*) FILTER (split = 'test' AND y_bin = 1) AS test_attack FROM rp GROUP BY cut) s
 LEFT JOIN (SELECT cut, count(*) FILTER (n_train = 0 AND n_test >= 20) AS novel, count(*) FILTER (n_train = 0 AND n_test BETWEEN 1 AND 19) AS near FROM (
  SELECT cut, code, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test' AND y_cls = code) AS n_test FROM rp, codes WHERE code > 0 AND (class_mask & (1 << code)) <> 0 GROUP BY cut, code) GROUP BY cut) c USING (cut)""",
                ROLLING, "rp AS (SELECT w.*, r.cut, r.split FROM win w JOIN rolling r USING (grp))", late=True))
def rolling_feasibility(spark, sf):
    w = windows(spark, sf, True)
    return S.rolling_feasibility(w, S.rolling_cut_split(w, CUTS), classes(spark, sf, True))


HEAD_TAIL = "ht AS (SELECT grp, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.8 * sum(n) OVER () THEN 'head' ELSE 'tail' END AS side FROM split WHERE split = 'train')"


@query(windowed("SELECT grp, n, side FROM ht", SPLIT_GAP, HEAD_TAIL))
def head_tail_train(spark, sf):
    return S.head_tail_train(placed(spark, sf))


# Blocks of 10 seconds leave gaps between events, so capture days and purging have something to do.
SHORT_BLOCKS = """blk AS (SELECT DISTINCT CAST(floor(epoch_us(ts) / 1000.0 / 10000.0) AS BIGINT) AS block FROM events),
days AS (SELECT block, CAST(sum(new) OVER (ORDER BY block) AS INTEGER) AS day FROM (SELECT block, CASE WHEN block - lag(block) OVER (ORDER BY block) >= 36 THEN 1 ELSE 0 END AS new FROM blk)),
shuffled AS (SELECT block, day, row_number() OVER (PARTITION BY day ORDER BY md5(block || ':17'), block) AS place, count(*) OVER (PARTITION BY day) AS n FROM days),
daysplit AS (SELECT block, day, CASE WHEN place <= floor(0.6 * n + 0.5) THEN 'train' WHEN place <= floor(0.6 * n + 0.5) + floor(0.2 * n + 0.5) THEN 'val' ELSE 'test' END AS split FROM shuffled),
p1 AS (SELECT d.*, split IN ('train', 'val') AND EXISTS (SELECT 1 FROM daysplit t WHERE t.day = d.day AND t.split = 'test' AND abs(t.block - d.block) = 1) AS by_test FROM daysplit d),
purged AS (SELECT block, day, split, by_test OR (split = 'train' AND EXISTS (SELECT 1 FROM p1 v WHERE v.day = p1.day AND v.split = 'val' AND NOT v.by_test AND abs(v.block - p1.block) = 1)) AS purged FROM p1)"""


def short_blocks(spark, sf):
    from noveltybench.plans.base import millis, table

    blocks = table(spark, sf, "events").select(F.floor(millis("ts") / 10_000.0).alias("block")).distinct()
    return S.capture_days(blocks)


@query("WITH " + SHORT_BLOCKS + " SELECT block, day FROM days")
def capture_days(spark, sf):
    return short_blocks(spark, sf)


@query("WITH " + SHORT_BLOCKS + " SELECT block, day, split FROM daysplit")
def split_per_day_shuffle(spark, sf):
    return S.split_per_day_shuffle(short_blocks(spark, sf), SEED)


def purged(spark, sf):
    return S.purge_adjacent_blocks(S.split_per_day_shuffle(short_blocks(spark, sf), SEED))


@query("WITH " + SHORT_BLOCKS + " SELECT block, day, split, purged FROM purged")
def purge_adjacent_blocks(spark, sf):
    return purged(spark, sf)


@query(windowed("SELECT split, CAST(sum(n) AS BIGINT) AS n, sum(n) / (SELECT sum(n) FROM split) AS share FROM split GROUP BY split", SPLIT_GAP))
def split_shares_report(spark, sf):
    return S.split_shares(S.split_temporal_gap(windows(spark, sf)))


# ---- validators -----------------------------------------------------------------------------------------------


def _check(name: str, violations: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(({violations}) AS BIGINT) AS violations, ({violations}) = 0 AS ok"


@query(windowed(_check("hash_unique", "SELECT count(*) FROM (SELECT sha FROM deduped GROUP BY sha HAVING count(*) > 1)"), HASHED, DEDUPED))
def verify_hash_unique(spark, sf):
    return V.unique(W.dedupe_windows(hashed(spark, sf)), "sha", "hash_unique")


@query(windowed(_check("hash_disjoint", "SELECT count(*) FROM (SELECT sha FROM deduped JOIN split USING (grp) WHERE split <> 'gap' GROUP BY sha HAVING count(DISTINCT split) > 1)"), HASHED, DEDUPED, SPLIT_GAP))
def verify_hash_disjoint(spark, sf):
    w = W.dedupe_windows(hashed(spark, sf)).join(S.split_temporal_gap(windows(spark, sf)).select("grp", "split"), "grp")
    return V.disjoint(w.where("split <> 'gap'"), "sha", "split", "hash_disjoint")


@query(windowed(_check("group_disjoint", "SELECT count(*) FROM (SELECT grp FROM placed GROUP BY grp HAVING count(DISTINCT split) > 1)"), SPLIT_GAP, PLACED))
def verify_group_disjoint(spark, sf):
    return V.disjoint(placed(spark, sf), "grp", "split", "group_disjoint")


@query(windowed(_check("row_disjoint", "SELECT count(*) FROM (SELECT row_id FROM exploded JOIN split USING (grp) GROUP BY row_id HAVING count(DISTINCT split) > 1)"), SPLIT_GAP))
def verify_row_disjoint(spark, sf):
    rows = exploded(spark, sf).join(S.split_temporal_gap(windows(spark, sf)).select("grp", "split"), "grp")
    return V.disjoint(rows, "row_id", "split", "row_disjoint")


SETS_CHECK = """SELECT check_name, CAST(v AS BIGINT) AS violations, v = 0 AS ok FROM (
 SELECT 'no_window_twice' AS check_name, count(*) AS v FROM (SELECT set_name, window_id FROM sets GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'right_split', count(*) FROM sets s JOIN placed p USING (window_id) WHERE p.split <> replace(s.set_name, '_natural', '')
 UNION ALL SELECT 'below_cap', count(*) FROM (SELECT set_name FROM sets GROUP BY set_name HAVING count(*) > CASE set_name WHEN 'train' THEN 14000 WHEN 'test_natural' THEN 20000 ELSE 3000 END)
 UNION ALL SELECT 'exact_ratio', count(*) FROM (SELECT set_name FROM sets WHERE set_name <> 'test_natural' GROUP BY set_name HAVING count(*) FILTER (y_bin = 0) <> count(*) FILTER (y_bin = 1) * CASE set_name WHEN 'train' THEN 1 ELSE 5 END))"""


@query(windowed(SETS_CHECK, *SETS))
def verify_sets(spark, sf):
    p = placed(spark, sf)
    return V.sets(S.make_sets(p, SEED), p, {"train": 14000, "val": 3000, "test": 3000, "test_natural": 20000}, {"train": 1, "val": 5, "test": 5})


LOACO_CHECK = """SELECT check_name, CAST(v AS BIGINT) AS violations, v = 0 AS ok FROM (
 SELECT 'class_absent' AS check_name, count(*) AS v FROM folds f JOIN placed p USING (window_id) WHERE part <> 'test' AND (class_mask & (1 << fold)) <> 0
 UNION ALL SELECT 'part_is_split', count(*) FROM folds f JOIN placed p USING (window_id) WHERE part <> p.split
 UNION ALL SELECT 'test_is_benign_or_held_out', count(*) FROM folds f JOIN placed p USING (window_id) WHERE part = 'test' AND p.y_bin = 1 AND y_cls <> fold)"""


@query(windowed(LOACO_CHECK, *FOLDS))
def verify_loaco(spark, sf):
    return V.loaco(folds(spark, sf), placed(spark, sf))


NOVELTY_CHECK = """SELECT check_name, CAST(v AS BIGINT) AS violations, v = 0 AS ok FROM (
 SELECT 'class_absent' AS check_name, count(*) AS v FROM novelty f JOIN placed p USING (window_id), novel n WHERE part <> 'test' AND (class_mask & (1 << n.code)) <> 0
 UNION ALL SELECT 'part_is_split', count(*) FROM novelty f JOIN placed p USING (window_id) WHERE part <> p.split
 UNION ALL SELECT 'class_tested', count(*) FROM novel n WHERE NOT EXISTS (SELECT 1 FROM novelty f WHERE f.part = 'test' AND f.cls = n.code AND f.y_bin = 1))"""


@query(windowed(NOVELTY_CHECK, *NOVELTY, late=True))
def verify_natural_novelty(spark, sf):
    p = placed(spark, sf, True)
    return V.natural_novelty(novelty(spark, sf), p, S.nn_class_discovery(p, classes(spark, sf, True)))


@query("WITH " + SHORT_BLOCKS + """ SELECT check_name, CAST(v AS BIGINT) AS violations, v = 0 AS ok FROM (
 SELECT 'kept_beside_test' AS check_name, count(*) AS v FROM purged a JOIN purged b ON a.day = b.day AND b.split = 'test' AND a.block - b.block IN (-1, 1) WHERE NOT a.purged AND a.split <> 'test'
 UNION ALL SELECT 'train_beside_val', count(*) FROM purged a JOIN purged b ON a.day = b.day AND b.split = 'val' AND NOT b.purged AND a.block - b.block IN (-1, 1) WHERE NOT a.purged AND a.split = 'train')""")
def verify_purge(spark, sf):
    return V.purge(purged(spark, sf))


FLAG = """SELECT split, y_cls, count(*) AS windows, CAST(sum(y_bin) AS BIGINT) AS attack_windows FROM placed JOIN deduped USING (grp, k) GROUP BY split, y_cls"""


@query(windowed(FLAG, HASHED, DEDUPED, SPLIT_GAP, PLACED))
def flagship_composition(spark, sf):
    """Windows of each majority class by split after duplicates are gone."""
    kept = placed(spark, sf).join(W.dedupe_windows(hashed(spark, sf)).select("grp", "k"), ["grp", "k"], "left_semi")
    return kept.groupBy("split", "y_cls").agg(F.count(F.lit(1)).alias("windows"), F.sum("y_bin").alias("attack_windows"))
