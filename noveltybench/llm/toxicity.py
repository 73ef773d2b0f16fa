"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any texts are the unlabelled.  With
class prior p, losses l and scores f the classifier minimises

    p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)])

so that the estimated risk of the clean class can't turn negative.  Features
are the presence of hashed words and of hashed runs of GRAM bytes, kept where
they are commoner among positives than chance allows.  A long text has more runs
by chance, so they count less the longer it is; words count alike in any text.

Fitting uses at most POSITIVES + UNLABELLED rows (those of smallest hash, one
row an id), whole texts of any length, and KEPT features.  Features are counted
in Spark; the driver gets the kept ones and which rows have them.

Defined cases: a null or empty text has no features; without a positive every
score is 0 (to 17 digits); of rows that share an id the text of smallest hash is
learned from, and each is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.labelled import fold, one_text, spread_ids
from noveltybench.llm.storage import unused, with_fields
from noveltybench.llm.textops import LOWER, NON_SPACE, distinct, mix, slices, text_buffer, word_hashes, word_spans

GRAM, BITS = 5, 22
POSITIVES, UNLABELLED, KEPT = 2_500, 10_000, 2_000
#: A kept feature is this many standard deviations commoner among positives, and in this share and number of them.
LEAST_Z, LEAST_SHARE, LEAST_ROWS = 3.5, 0.01, 4
#: Features of texts that a task holds before it counts them.
HELD = 1 << 23
#: A run of bytes is worth 1 / root of 1 + bytes of its text (up to LONG) / SHORT; features of runs are even numbers, of words odd.
SHORT, LONG = 300, 4_000


def worth(features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the features of texts of these sizes count."""
    return np.where(features & 1, 1.0, 1 / np.sqrt(1 + np.minimum(sizes, LONG) / SHORT))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Feature number of the GRAM bytes from each place (the last places have none)."""
    n = max(len(data) - GRAM + 1, 0)
    packed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        packed = (packed << np.uint64(8)) | data[k : k + n]
    packed *= np.uint64(0x9E3779B97F4A7C15)
    packed ^= packed >> np.uint64(29)
    packed *= np.uint64(0xBF58476D1CE4E5B9)
    return (packed >> np.uint64(64 - BITS)).astype(np.int32) & ~1


def presence(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, rows, features) of the distinct features present, only the wanted ones if given."""
    data, offsets = text_buffer(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        part = LOWER[data[at[0] : at[-1]]]
        at = at - at[0]
        grams = _gram_hashes(part)
        starts, ends, before = word_spans(part, at, NON_SPACE)
        words = (mix(word_hashes(part, starts, ends)) >> np.uint64(64 - BITS)).astype(np.int32) | 1
        places = np.arange(len(grams)) if wanted is None else np.flatnonzero(wanted[grams])
        rows = np.searchsorted(at, places, side="right") - 1
        good = places + GRAM <= at[rows + 1]
        kept = np.arange(len(words)) if wanted is None else np.flatnonzero(wanted[words])
        both = np.concatenate([rows[good].astype(np.int64) << BITS | grams[places[good]], (np.searchsorted(before, kept, side="right") - 1).astype(np.int64) << BITS | words[kept]])
        both = distinct(both)
        yield first, last, both >> BITS, both & ((1 << BITS) - 1)


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, ridge: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear classifier, by Adam on the non-negative risk with the logistic loss."""
    w, b = np.zeros(positive.shape[1], np.float32), np.float32(-1)
    m = np.zeros(len(w) + 1, np.float32)
    v = np.zeros(len(w) + 1, np.float32)

    def up(f: np.ndarray) -> np.ndarray:  # derivative of l(-f) = log(1 + exp(f))
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))

    for step in range(1, steps + 1):
        fp, fu = positive @ w + b, unlabelled @ w + b
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp = prior * (up(fp) - 1) / len(fp)  # of the positive part
        cu, cp = up(fu) / len(fu), -prior * up(fp) / len(fp)  # of the clean part
        if clean < 0:  # step back from the negative risk instead
            gp, cu, cp = np.zeros_like(gp), -cu, -cp
        g = np.append(positive.T @ (gp + cp) + unlabelled.T @ cu + ridge * w, (gp + cp).sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


class Classifier:
    """Weights by feature number; about 20 MB, made in the worker from a few kilobytes."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, offset: float):
        self.kept, self.weights, self.offset = kept, weights, offset
        self.wanted: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"wanted": None}

    def scores(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        if self.wanted is None:
            self.wanted = np.zeros(1 << BITS, bool)
            self.wanted[self.kept] = True
        sizes = np.diff(text_buffer(column)[1])
        for first, last, rows, found in presence(column, self.wanted):
            evidence = self.weights[np.searchsorted(self.kept, found)] * worth(found, sizes[first + rows])
            f = self.offset + np.bincount(rows, evidence, minlength=last - first)
            yield first, last, 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, p, u): in how many positives and unlabelled rows a feature is; ``rows`` has in_p, in_u and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            both = np.sort(np.concatenate(held))  # feature, then whether in p
            at = np.flatnonzero(np.diff(both, prepend=-1))
            seen, n = both[at], np.diff(at, append=len(both))
            return pa.RecordBatch.from_arrays([pa.array((seen >> 1).astype(np.int32)), pa.array(n * (seen & 1)), pa.array(n * (1 - (seen & 1)))], names=["feature", "p", "u"])

        for batch in batches:
            of = [batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (0, 1)]
            for first, _, places, found in presence(batch.column(2)):
                for side, code in ((0, 1), (1, 0)):
                    held.append(found[of[side][first + places]] << 1 | code)
                    size += len(held[-1])
                if size > HELD:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    return rows.select("in_p", "in_u", "text").mapInArrow(run, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _telling(counted: DataFrame, n: int, k: int) -> np.ndarray:
    """The KEPT features that are most clearly commoner among the n positives than among the k unlabelled rows."""
    both = (F.col("p") + F.col("u")) / (n + k)
    z = (F.col("p") / n - F.col("u") / k) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / n + 1 / k))
    good = counted.where(F.col("p") >= max(LEAST_ROWS, LEAST_SHARE * n)).withColumn("z", z).where(F.col("z") > LEAST_Z)
    return np.sort(np.array([r["feature"] for r in good.orderBy(F.desc("z"), "feature").limit(KEPT).collect()], np.int64))


def _matrix(rows: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in_p, in_u) of the rows, in a fixed order, and what each kept feature is worth in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[kept] = True
        for batch in batches:
            sizes = np.diff(text_buffer(batch.column(2))[1])
            for first, last, places, found in presence(batch.column(2), wanted):
                ends = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=last - first))]).astype(np.int32)
                has = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.searchsorted(kept, found).astype(np.int32)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(0), part.column(1), pa.array(sizes[first:last]), has], names=["place", "in_p", "in_u", "size", "has"])

    found = sorted(tuple(r) for r in rows.select("in_p", "in_u", "text", "place").mapInArrow(run, "place long, in_p boolean, in_u boolean, size long, has array<int>").collect())
    out = np.zeros((len(found), len(kept)), np.float32)
    for row, (*_, size, has) in enumerate(found):
        out[row, has] = worth(kept[has], np.full(len(has), size))
    return np.array([f[1:3] for f in found], bool).reshape(-1, 2), out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None) -> Classifier:
    """Fitted on the positives of the given labels and any of the given documents.

    ``prior`` is the share of toxic texts; unknown, it is the share among the given labels.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if prior is None:
        prior = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0] or 0.0
    p = {k for _, k in spread_ids(known.where(F.col(label) > 0), key, None, POSITIVES, 31)}
    u = {k for _, k in spread_ids(docs.where(F.col(text).isNotNull()), key, None, UNLABELLED, 37)}
    nothing = Classifier(np.zeros(0, np.int64), np.zeros(0), -40.0)
    if not p or not u or prior <= 0:
        return nothing
    sample = docs.sparkSession.createDataFrame([(k, k in p, k in u, i) for i, k in enumerate(sorted(p | u))], f"key {docs.schema[key].dataType.simpleString()}, in_p boolean, in_u boolean, place long")
    rows = one_text(docs, key, text, sample)
    n, k = rows.agg(F.count_if("in_p"), F.count_if("in_u")).first()
    if not n or not k:
        return nothing
    kept = _telling(_counted(rows), n, k)
    of, x = _matrix(rows, kept)
    weights, offset = nn_pu(x[of[:, 0]], x[of[:, 1]], prior)
    return Classifier(kept, weights, offset)


def score(df: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1; a column of that name is replaced."""
    kept = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, scores in shared.value.scores(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, out])

    return kept.mapInArrow(run, with_fields(kept, (out, "double")))


def remove_toxic(docs: DataFrame, model: Classifier, threshold: float = 0.5, text: str = "text") -> DataFrame:
    name = unused("score", docs.columns)
    return score(docs, model, text, name).where(F.col(name) < threshold).drop(name)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5)."""
    model = fit(docs.where(fold("doc_id") != 0), labels.where(fold("doc_id") != 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
