"""Quality scores by Bradley-Terry pairwise ranking.

Each text has a style vector (shares of byte values, word lengths, repetition).
Preference pairs (a better and a worse labelled text) are fitted by logistic
loss on feature differences; the ranking score is then put on 0..1 by a logistic
curve that knows the share of good labels.  `above_quantile` thresholds by a
quantile of the scores.

Fitting uses at most ROWS labelled texts of either label (those of smallest hash; of rows that share an id, the text of
smallest hash) and PAIRS pairs.

Defined cases: a null or empty text has the vector of no bytes and a score like
any other; with only one label present every score is that label's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.labelled import fold, one_text, spread_ids
from noveltybench.llm.storage import with_fields
from noveltybench.llm.textops import LOWER, NON_SPACE, slices, text_buffer, word_hashes, word_spans

ROWS, PAIRS, RIDGE = 1_500, 30_000, 1e-3
N_FEATURES = 96 + 2 + 8


def style(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, feature matrix) of a text column, whole texts, by bounded slices."""
    data, offsets = text_buffer(column)
    group = np.full(256, 97, np.int64)  # bytes of non-ASCII characters
    group[:32] = 96
    group[32:128] = np.arange(96)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        part, rows, sizes = data[at[0] : at[-1]], last - first, np.diff(at)
        of_row = np.repeat(np.arange(rows), sizes)
        counts = np.bincount(of_row * 98 + group[part], minlength=rows * 98).reshape(rows, 98).astype(float)
        out = np.zeros((rows, N_FEATURES))
        out[:, :98] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
        low = LOWER[part]
        starts, ends, before = word_spans(low, at - at[0], NON_SPACE)
        words = word_hashes(low, starts, ends)
        n = np.diff(before)
        row_of_word = np.repeat(np.arange(rows), n)
        length = (ends - starts).astype(float)
        same = np.zeros(len(words))
        same[1:] = (words[1:] == words[:-1]) & (row_of_word[1:] == row_of_word[:-1])
        shouted = np.add.reduceat(np.append(((part >= 65) & (part <= 90)).astype(np.int64), 0), starts) if len(starts) else np.zeros(0)
        order = np.lexsort((words, row_of_word))
        fresh = np.ones(len(words))
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (row_of_word[order][1:] != row_of_word[order][:-1])

        def mean(values: np.ndarray, of: np.ndarray = row_of_word, rows: int = rows, n: np.ndarray = n) -> np.ndarray:
            return np.bincount(of, values, minlength=rows) / np.maximum(n, 1)

        out[:, 98] = np.log1p(sizes) / 10
        out[:, 99] = np.log1p(n) / 10
        out[:, 100] = mean(length) / 10
        out[:, 101] = np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 10
        out[:, 102] = mean(same)
        out[:, 103] = mean(fresh, row_of_word[order]) if len(words) else 0
        out[:, 104] = mean((shouted > 2).astype(float)) if len(words) else 0
        out[:, 105] = (sizes == 0).astype(float)
        yield first, last, out


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and style vector of each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, x in style(batch.column(1)):
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), vectors], names=["key", "style"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, style array<double>")


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights w for which better beats worse with probability 1 / (1 + exp(-w.(better - worse))): Newton steps."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def curve(scores: np.ndarray, good: np.ndarray, weights: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from ranking score to probability of a good label."""
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    ab = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        gradient = x.T @ (weights * (p - good)) / weights.sum() + 1e-4 * ab
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x / weights.sum() + 1e-4 * np.eye(2)
        ab -= np.linalg.solve(hessian, gradient)
    return float(ab[0]), float(ab[1])


class Ranking:
    """Fitted weights, standardisation and curve; a few kilobytes."""

    def __init__(self, x: np.ndarray, good: np.ndarray, share_good: float, seed: int = 17):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        a, b = np.flatnonzero(good), np.flatnonzero(~good)
        self.weights = bradley_terry(z[rng.choice(a, PAIRS)], z[rng.choice(b, PAIRS)])
        weights = np.where(good, share_good / len(a), (1 - share_good) / len(b))
        self.slope, self.offset = curve(z @ self.weights, good.astype(float), weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.offset, -40, 40)))


class Constant:
    """What is known when one label is missing: its share."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking | Constant:
    """Fitted on the given labels only; the caller leaves out what must stay unseen."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    share = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    chosen = {k: bool(good) for good, k in spread_ids(known.select(key, (F.col(label) > 0).alias("good")), key, "good", ROWS, 29)}
    if not chosen:
        return Constant(0.5 if share is None else share)
    sample = docs.sparkSession.createDataFrame(sorted(chosen.items()), f"key {docs.schema[key].dataType.simpleString()}, good boolean")
    rows = {r["key"]: r["style"] for r in features(one_text(docs, key, text, sample), "key", "text").collect()}
    x = np.array([rows[k] for k in sorted(rows)]).reshape(-1, N_FEATURES)
    good = np.array([chosen[k] for k in sorted(rows)], bool)
    if not good.any() or good.all():
        return Constant(0.5 if share is None else share)
    return Ranking(x, good, share)


def score(df: DataFrame, model: Ranking | Constant, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1; a column of that name is replaced."""
    kept = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, x in style(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(x))], names=[*part.schema.names, out])

    return kept.mapInArrow(run, with_fields(kept, (out, "double")))


def above_quantile(scored: DataFrame, quantile: float, column: str = "score") -> DataFrame:
    """Rows whose score is at least the given quantile of all scores."""
    cut = scored.agg(F.percentile_approx(column, quantile, 10_000).alias("cut"))
    return scored.join(F.broadcast(cut), F.col(column) >= F.col("cut"), "inner").drop("cut")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3)."""
    model = fit(docs, labels.where(fold("doc_id") != 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
