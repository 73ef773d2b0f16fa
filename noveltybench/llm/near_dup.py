"""MinHash near-duplicate groups with tensored banding.

A text is the set of its distinct n-word shingles.  Two collections of ``bands``
hashes (each of ``rows`` minhashes) are computed; every pair of one hash from
either collection is a table key, so bands**2 tables cost 2 * bands * rows
minhashes instead of bands**2 * rows * 2.

Texts with equal sets form one class.  In each table bucket all classes are
compared with the bucket's centre (the class that shares most buckets) and small
buckets are compared pair by pair.  A larger bucket whose members are then still
in several components goes through an exact prefix filter: of all classes in such
buckets, two that are linked share a shingle among the rarest of either, so only
classes of different components that share one are compared.  So no link inside a
bucket is missed, nothing is capped, and members that stay unlinked are not
compared with each other.  Every link is confirmed on the full sets; groups are
the connected components of the links.

A pair at similarity 0.85 shares no bucket with probability
2 * (1 - 0.85**rows) ** bands (0.0004 for the defaults; 0.0015 at 0.8 with 10 bands).

Defined cases: a null or word-less text has an empty set and is linked with
nothing; fewer words than a shingle are one shingle; rows are answered one by
one, repeated rows alike; rows that share an id are one document for grouping,
linked with all that any of their texts is linked with; a null id is never
grouped (component_id null, kept).  Columns of ``keep_one`` pass through
whatever their names.  Components that need more than ``most_rounds`` rounds
(chains of more than about 2**50 classes) are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.storage import stored, unused
from noveltybench.llm.textops import mix, row_shingles, splitmix

BANDS, ROWS = 9, 3
PRINT = ["print1", "print2", "n_shingles"]
#: Buckets up to this size are compared pair by pair; larger ones by centre and prefix filter, with equal answers.
SMALL = 8
#: Parts of a shingle's classes, each compared by a task of its own.
SALTS = 16
#: Shingles whose minhashes are taken at once.
_STEP = 4_096


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, two halves of the set's fingerprint, and the 2 * bands composite hashes."""
    factors = splitmix(2 * bands * rows, 5) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            prints = np.zeros((batch.num_rows, 2), np.int64)
            lowest = np.zeros((batch.num_rows, len(factors)), np.uint64)
            for row, grams in row_shingles(batch.column(2), shingle):
                n[row] = len(grams)
                prints[row] = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)
                for at in range(0, len(grams), _STEP):
                    found = (grams[at : at + _STEP, None] * factors).min(axis=0)
                    lowest[row] = np.minimum(lowest[row], found) if at else found
            bands_of = mix(lowest).reshape(batch.num_rows, 2 * bands, rows)
            composite = np.zeros((batch.num_rows, 2 * bands), np.uint64)
            for r in range(rows):
                composite = mix(composite * np.uint64(31) + bands_of[:, :, r])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * 2 * bands, pa.int32()), pa.array(composite.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists], names=["doc_id", "text_hash", "n_shingles", "print1", "print2", "hashes"])

    return _texts(docs, key, text).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, print1 long, print2 long, hashes array<long>")


def class_sets(docs: DataFrame, wanted: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rep, grams (array of distinct 64-bit shingles) of the text that stands for each wanted class (doc_id, text_hash, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams = [g for _, g in row_shingles(part.column(1), shingle)]
                ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams).view(np.int64)))], names=["rep", "grams"])

    texts = _texts(docs, key, text).join(wanted.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return texts.select("rep", "text").mapInArrow(run, "rep long, grams array<long>")


def table_keys(classes: DataFrame, bands: int = BANDS) -> DataFrame:
    """(key, rep): the bands**2 tensored keys of each class."""
    tables = F.sequence(F.lit(0), F.lit(bands * bands - 1))
    key = F.transform(tables, lambda t: F.xxhash64(t, F.element_at("hashes", (t / bands).cast("int") + 1), F.element_at("hashes", t % bands + bands + 1)))
    return classes.select(F.explode(key).alias("key"), "rep")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.where(100 * common >= percent * (F.size("grams_a") + F.size("grams_b") - common)).select("a", "b")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of an undirected link table (a, b): the smallest node reachable.

    Each round every node takes the smallest label around it, whole labels are
    hooked onto the smallest label seen by any of their nodes, and labels are
    shortened by one jump.  Rounds are cut off by written tables.
    """
    spark = links.sparkSession
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"), F.lit(True).alias("moved")), "labels")
    for _ in range(most_rounds):
        around = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooks = labels.join(around, "node").groupBy("component").agg(F.min("near").alias("near")).where("near < component")
        jumped = hooks.join(hooks.select(F.col("component").alias("near"), F.col("near").alias("far")), "near", "left").select("component", F.coalesce("far", "near").alias("low"))
        labels = stored(labels.drop("moved").join(jumped, "component", "left").select("node", F.coalesce("low", "component").alias("component"), F.col("low").isNotNull().alias("moved")), "labels")
        if not labels.where("moved").take(1):
            return labels.drop("moved")
    raise RuntimeError(f"no end after {most_rounds} rounds on {spark.sparkContext.applicationId}")


def _centres(members: DataFrame, weights: DataFrame) -> DataFrame:
    """The heaviest class of each bucket (the smaller id at a tie)."""
    best = F.max(F.struct("weight", (-F.col("rep")).alias("low")))
    weighed = members.select("key", "rep").join(weights.hint("merge"), "rep")
    return weighed.groupBy("key").agg(best.alias("best")).select("key", (-F.col("best.low")).alias("centre"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n, component, place): the shingles by which a link may be found, rarest first in each set.

    Sets of sizes m and n whose overlap is at least o share one of the m - o + 1 rarest of the one and the n - o + 1
    rarest of the other; o is at least percent / 100 of either size.
    """
    tokens = sets.select("rep", "component", F.size("grams").alias("n"), F.explode("grams").alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = tokens.join(counted.hint("merge"), "token").groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    placed = ordered.select("rep", "component", "n", F.posexplode(F.slice("tokens", F.lit(1), most)).alias("place", "found"))
    return placed.where("found.df > 1").select(F.col("found.token").alias("token"), "rep", "n", "component", (F.col("place") + 1).alias("place"))


def possible_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that the prefix filter leaves."""
    parts = prefixes.groupBy("token", "component").agg(F.count(F.lit(1)).alias("parts"))
    main = parts.groupBy("token").agg(F.max_by("component", F.struct("parts", "component")).alias("main"), F.count(F.lit(1)).alias("apart")).where("apart > 1").select("token", "main")
    placed = stored(prefixes.join(main.hint("merge"), "token"), "prefixes")
    # A shingle's classes are dealt over SALTS tasks, which all get those outside its main component.
    outside = placed.where("component <> main").select("token", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"), F.col("component").alias("c"))
    others = placed.select("token", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"), "component", "main")
    overlap = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    near = (F.col("p_a") <= F.col("n_a") - overlap + 1) & (F.col("p_b") <= F.col("n_b") - overlap + 1)
    one_way = (F.col("component") == F.col("main")) | (F.col("a") < F.col("b"))
    same = (outside["token"] == others["token"]) & (outside["salt"] == others["salt"])
    return _ordered(outside.hint("merge").join(others, same & (F.col("c") != F.col("component")) & near & one_way).select("a", "b"))


def settled(members: DataFrame, sets: DataFrame, compared: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Components of ``links`` and of all links inside the large buckets, whose centres are in ``compared``."""
    labels = components(links)
    placed = members.where(F.col("size") > SMALL).join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    unsettled = stored(placed.join(apart.hint("merge"), "key", "left_semi").select("rep", "component").distinct(), "unsettled")
    if not unsettled.take(1):
        return labels
    prefixes = rarest(stored(sets.join(unsettled.hint("merge"), "rep"), "unsettled-sets"), percent)
    pairs = possible_pairs(prefixes, percent).join(compared.hint("merge"), ["a", "b"], "left_anti")
    more = stored(confirmed(pairs, sets, percent), "links")
    return components(links.union(more)) if more.take(1) else labels


def of_one_document(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of texts that share an id."""
    ends = F.struct(*PRINT)
    repeated = real.groupBy("doc_id").agg(F.min(ends).alias("low"), F.max(ends).alias("high")).where("low <> high").select("doc_id")
    own = real.select("doc_id", *PRINT).join(repeated, "doc_id", "left_semi").distinct().join(classes.select(*PRINT, "rep"), PRINT).select("doc_id", "rep")
    first = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return own.join(first, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id) for each row."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = stored(signatures(docs, shingle, bands, rows, key, text), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy(*PRINT).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("hashes").alias("hashes"))
    classes = classes.select(*PRINT, F.col("first.doc_id").alias("low"), F.col("first.text_hash").alias("text_hash"), "copies", "hashes")
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbered once, when written

    keys = table_keys(classes.select("rep", "hashes").repartition(tasks, "rep"), bands)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(keys.join(shared, "key").distinct(), "members")
    weights = stored(members.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("weight")), "weights")
    wanted = classes.join(weights.hint("merge"), "rep", "left_semi").select(F.col("low").alias("doc_id"), "text_hash", "rep")
    sets = stored(class_sets(docs, wanted, shingle, key, text), "sets")

    centred = members.join(_centres(members, weights).hint("merge"), "key")
    small = members.where(F.col("size") <= SMALL)
    pairs = centred.select(F.col("rep").alias("a"), F.col("centre").alias("b")).union(
        small.select("key", F.col("rep").alias("a")).join(small.select("key", F.col("rep").alias("b")), "key").where("a < b").select("a", "b")
    )
    pairs = stored(_ordered(pairs), "pairs")
    links = stored(confirmed(pairs, sets, percent).union(of_one_document(real, classes)), "links")
    labels = settled(members, sets, pairs, links, percent)

    lows = labels.join(classes.select(F.col("rep").alias("node"), "low"), "node").groupBy("component").agg(F.min("low").alias("group_id"))
    grouped = labels.join(lows.hint("merge"), "component").select(F.col("node").alias("rep"), "group_id")
    found = classes.join(grouped.hint("merge"), "rep", "left").where("copies > 1 or group_id <> low").select(*PRINT, F.coalesce("group_id", "low").alias("group_id"))
    answered = signed.select("doc_id", *PRINT).join(found, PRINT, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("group_id", "doc_id")).otherwise(F.col("doc_id"))
    return answered.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 10) -> DataFrame:
    """One document of each group of near-duplicates (the smallest id; rows that repeat it stay with it)."""
    name = unused("removed", docs.columns)
    removed = groups(docs, shingle, percent, bands=bands).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(removed, docs["doc_id"].cast("long") == F.col(name), "left_anti")
