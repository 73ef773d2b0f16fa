"""Detectors fitted on a benign reference; a higher score is more anomalous.

Moments are summed by Spark and only matrices of the vectors' width reach the
driver.  kNN searches the whole reference in blocks; the isolation forest uses a
bounded, reproducible sample of it (``TREE_ROWS`` rows a tree).  Every row is scored.

A vector that is null, empty, or holds a null or non-finite entry is left out of the reference, and its own score is
null; without a usable reference every score is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltybench.sources.tables import shared_path

TREE_ROWS, TREES, NEIGHBOUR = 256, 200, 10
#: Reference rows and probes whose distances the kNN search holds at once, and most probes of a task (of 64 entries; fewer of wider ones).
BLOCK_ROWS, PROBE_ROWS, PART_ROWS = 2_048, 512, 65_536


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors without null or non-finite entries, of ``width`` entries if given."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    width = int(sizes[good][0]) if width is None and good.any() else width or 0
    rows = np.flatnonzero(good & (sizes == width))
    return rows, values[(ends - sizes)[rows][:, None] + np.arange(width)]


def moments(vectors: DataFrame, column: str = "x") -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, covariance with divisor n) of the usable vectors: partial sums of each partition, added up by Spark.

    Vectors that are null, or hold a null or non-finite entry, don't count; without any, n is 0 and the rest empty.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            _, x = usable(b.column(0), None if total is None else len(total) - 1)
            if len(x):
                z = np.hstack([np.ones((len(x), 1)), x])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    rows = vectors.select(column).mapInArrow(partial, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not rows:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    d = max(r["i"] for r in rows) + 1
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = r["s"]
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def scored(vectors: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str = "x", out: str = "score", width: int | None = None) -> DataFrame:
    """``vectors`` without the vector column, with a score of each row; null where the vector is unusable or not as wide as asked."""
    rest = [c for c in vectors.columns if c != column]
    kept = vectors.select(*rest, column)
    schema = ", ".join([*[f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest], f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = usable(b.column(len(rest)), width)
            score, known = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            if len(x):
                score[rows], known[rows] = f(x), True
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(score, mask=~known)], names=[*rest, out])

    return kept.mapInArrow(run, schema)


def unscored(vectors: DataFrame) -> DataFrame:
    """What every detector answers without a usable reference: null scores."""
    return vectors.drop("x").withColumn("score", F.lit(None).cast("double"))


def ledoit_wolf(reference: DataFrame, column: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(mean, shrunk covariance): shrinkage min(beta, delta) / delta towards the mean variance, from moments alone."""
    n, mean, s = moments(reference, column)
    d = len(mean)
    if not n:
        return mean, s
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum()
    fourth = scored(reference.select(column), lambda x: ((x - mean) ** 2).sum(axis=1) ** 2, column, width=d).agg(F.sum("score")).first()[0]
    beta = (fourth / n - (s**2).sum()) / n
    shrink = min(beta, delta) / delta if delta > 0 else 0.0
    return mean, (1 - shrink) * s + shrink * mu * np.eye(d)


def mahalanobis(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """Distance from the reference's mean under its shrunk covariance (a pseudo-inverse where that is singular)."""
    mean, cov = ledoit_wolf(reference)
    if not len(mean):
        return unscored(vectors)
    precision = np.linalg.pinv(cov, hermitian=True)
    return scored(vectors, lambda x: np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", x - mean, precision, x - mean), 0)), width=len(mean))


def whitener(s: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    """Inverse square root of a covariance shrunk by ``shrinkage`` of its mean variance."""
    d = len(s)
    values, vectors = np.linalg.eigh((1 - shrinkage) * s + shrinkage * np.trace(s) / d * np.eye(d))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T


def whitened_norm(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    n, mean, s = moments(reference)
    if not n:
        return unscored(vectors)
    w = whitener(s)
    return scored(vectors, lambda x: np.linalg.norm((x - mean) @ w, axis=1), width=len(mean))


def pca_reconstruction(vectors: DataFrame, reference: DataFrame, explained: float = 0.95) -> DataFrame:
    """Mean squared error after projection on the leading components that explain ``explained`` of the variance."""
    n, mean, s = moments(reference)
    if not n:
        return unscored(vectors)
    values, basis = np.linalg.eigh(s)
    values, basis = values[::-1], basis[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), explained)) + 1
    top = basis[:, :k]
    return scored(vectors, lambda x: (((x - mean) - (x - mean) @ top @ top.T) ** 2).mean(axis=1), width=len(mean))


def centroid(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """Distance from the reference's mean."""
    n, mean, _ = moments(reference)
    return scored(vectors, lambda x: np.linalg.norm(x - mean, axis=1), width=len(mean)) if n else unscored(vectors)


def score_grid(vectors: DataFrame, reference: DataFrame, checkpoints: dict[str, Column], fitted: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """(checkpoint, detector, the other columns of ``vectors``, score): every detector under every representation of ``x``.

    A checkpoint is an expression over ``x``.  A detector is fitted once a checkpoint on the whole reference and scores all
    rows; evaluation sets are a column of ``vectors`` that stays with them.
    """
    out = None
    for checkpoint, x in checkpoints.items():
        shown, known = vectors.withColumn("x", x), reference.withColumn("x", x)
        for name, detector in fitted.items():
            part = detector(shown, known).select(F.lit(checkpoint).alias("checkpoint"), F.lit(name).alias("detector"), *[c for c in vectors.columns if c != "x"], "score")
            out = part if out is None else out.unionByName(part)
    return out


def knn(vectors: DataFrame, reference: DataFrame, key: str, k: int = NEIGHBOUR) -> DataFrame:
    """Distance to the k-th neighbour (the farthest of fewer) in the whole L2-normalised reference.

    The reference is written once, in blocks; the probes are dealt into parts that a task holds, and each task reads the
    blocks past its part.  Neither is shuffled more than once, so what is moved and written grows with the rows, whatever
    the number of parts; a probe leaves its task as one row.
    """

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    whole = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    first = reference.where(whole).select(F.size("x")).first()
    if first is None:
        return unscored(vectors)
    width = first[0]
    block_rows, part_rows = (max(1, min(rows, rows * 64 // width)) for rows in (BLOCK_ROWS, PART_ROWS))
    x = F.col("x").cast("array<double>").alias("x")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block_rows):
                counts, rows = np.asarray(b.column(0).slice(i, block_rows)), unit(_matrix(b.column(1).slice(i, block_rows)))
                yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()]), pa.array([rows.tobytes()])], names=["n", "block"])

    # Rows of one vector are counted, k of them at most matter.
    known = reference.where(whole & (F.size("x") == width)).select(x).groupBy("x").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    path = shared_path(vectors.sparkSession, "knn")
    known.select("n", "x").mapInArrow(blocks, "n binary, block binary").write.parquet(path)
    passing = vectors.sparkSession.read.parquet(path).coalesce(1)

    n_rows, rest = vectors.count(), [c for c in vectors.columns if c != "x"]
    parts = max(1, -(-n_rows // part_rows), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n_rows // PROBE_ROWS)))
    part = F.pmod(F.xxhash64(key, "x", F.lit(41)), F.lit(parts)).cast("int").alias("part")
    held = vectors.select(part, F.struct(*rest, x).alias("row")).repartitionById(parts, F.col("part")).groupBy("part").agg(F.collect_list("row").alias("rows"))
    # A task has one part and all blocks: the reference's side is one partition, read anew by each task.
    met = passing.crossJoin(held.hint("shuffle_replicate_nl")).select("n", "block", "part", "rows")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = {}, {}
        for b in batches:
            for i, part in enumerate(b.column(2).to_pylist()):
                if part not in known:
                    given = b.column(3).slice(i, 1).flatten()
                    rows, vectors = usable(given.field("x"), width)
                    top = np.full((len(rows), k), -np.inf)
                    known[part], seen[part] = ([given.field(c) for c in rest], len(given), rows, unit(vectors), top, top.min(axis=1)), 0
                _, _, _, probe, top, least = known[part]
                passed = np.repeat(np.frombuffer(b.column(1)[i].as_buffer()).reshape(-1, width), np.frombuffer(b.column(0)[i].as_buffer(), np.int32), axis=0)
                seen[part] += len(passed)
                for r in range(0, len(passed), BLOCK_ROWS):
                    ref = passed[r : r + BLOCK_ROWS].T
                    for p in range(0, len(probe), PROBE_ROWS):
                        near = probe[p : p + PROBE_ROWS] @ ref
                        better = np.flatnonzero(near.max(axis=1) > least[p : p + PROBE_ROWS])
                        if len(better):
                            mine = np.partition(np.hstack([top[p + better], near[better]]), -k, axis=1)[:, -k:]
                            top[p + better], least[p + better] = mine, mine.min(axis=1)
        for part, (columns, n, rows, _, top, _) in known.items():
            score, there = np.zeros(n), np.zeros(n, bool)
            most = min(k, seen[part])
            score[rows], there[rows] = np.sqrt(np.maximum(2 - 2 * np.partition(top, k - most, axis=1)[:, k - most], 0)), True
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, mask=~there)], names=[*rest, "score"])

    schema = ", ".join([*[f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest], "score double"])
    return met.mapInArrow(nearest, schema)


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """Nested (dimension, cut, left, right) or (size,)."""
    if depth == 0 or len(x) <= 1:
        return (len(x),)
    spans = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    if not len(spans):
        return (len(x),)
    d = int(rng.choice(spans))
    cut = float(rng.uniform(x[:, d].min(), x[:, d].max()))
    left = x[:, d] < cut
    return (d, cut, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1))


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + _path(tree[0])
        return
    left = x[rows, tree[0]] < tree[1]
    _depths(tree[2], x, rows[left], depth + 1, out)
    _depths(tree[3], x, rows[~left], depth + 1, out)


def isolation_forest(vectors: DataFrame, reference: DataFrame, key: str, trees: int = TREES, rows: int = TREE_ROWS) -> DataFrame:
    """2 ** -(mean path / expected path); each tree is grown by a task from the ``rows`` rows of smallest hash under its number."""
    # The trees a row may be in are found from its key alone; only rows drawn carry their vectors on.
    whole = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    reference = reference.where(whole)
    n, spare = reference.count(), 2
    limit = 2**63 - 1 if n <= spare * rows else int(2**63 * (spare * rows / n))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.col(key), t), 1).alias("h")))
    sample = reference.select("x", F.explode(F.filter(draws, lambda d: d["h"] <= limit)).alias("d")).select(F.col("d.tree").alias("tree"), F.col("d.h").alias("h"), "x")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        x = np.array(pdf.sort_values("h")["x"].tolist()[:rows], dtype=np.float64)
        tree = _tree(x, np.random.default_rng(int(pdf["tree"].iloc[0])), int(np.ceil(np.log2(max(len(x), 2)))))
        return pd.DataFrame({"n": [len(x)], "tree": [pickle.dumps(tree)]})

    import pickle

    spark = vectors.sparkSession
    if not n:
        return unscored(vectors)
    grown = [(r["n"], pickle.loads(r["tree"])) for r in sample.groupBy("tree").applyInPandas(grow, "n long, tree binary").collect()]
    forest = spark.sparkContext.broadcast(grown)

    def score(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for _, tree in forest.value:
            _depths(tree, x, np.arange(len(x)), 0, out)
        expected = np.mean([_path(n) for n, _ in forest.value])
        return 2 ** (-out / len(forest.value) / max(expected, 1e-9))

    first = reference.select(F.size("x")).first()
    return scored(vectors, score, width=first[0])
