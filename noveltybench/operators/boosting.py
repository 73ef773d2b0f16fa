"""Gradient-boosted trees on binned vectors, by the second-order method: histograms of gradients, one pass a level.

Values are binned by approximate quantiles of each entry.  A pass sums gradients and curvatures by (node, entry, bin)
within each task and adds the sums in Spark; only these sums, bounded by nodes x entries x bins, reach the driver, which
chooses the splits.  Sums are of fixed-point numbers, so they don't depend on the partitioning and a retried task
changes nothing.  A training table of at most ``LOCAL_CELLS`` binned entries (its size is counted) is summed where the
splits are chosen, by the same function, with the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.operators.detectors import scored, unscored, usable
from noveltybench.sources.tables import shared_path

#: Bins an entry, a byte each; binned entries that are summed without Spark passes; rounds between two stored margins.
BINS, LOCAL_CELLS, STORE_EVERY = 64, 8_000_000, 10
#: Fixed-point unit of gradients and curvatures, and the smallest curvature of a child and the ridge of its weight.
UNIT, LEAST, RIDGE = 1 << 30, 1.0, 1.0


class Tree(NamedTuple):
    """Node i splits at ``bin <= cut`` of entry ``entry[i]`` into nodes 2i+1 and 2i+2, or ends (entry -1) with a weight."""

    entry: np.ndarray
    cut: np.ndarray
    weight: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n), np.zeros(n))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node each row ends in; works on bins, and on values if cuts are values."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.entry[node[rows]] >= 0]
            at = node[rows]
            node[rows] = 2 * at + 1 + (x[rows, self.entry[at]] > self.cut[at])
        return node


def drawn(keys: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
    """Rows of a round's sample: those whose mixed key falls below the share (alike on every partitioning)."""
    if share >= 1:
        return np.ones(len(keys), bool)
    salt = (round_ * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) % 2**64
    z = keys.astype(np.uint64) ^ np.uint64(salt)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (z >> np.uint64(11)).astype(float) < share * 2.0**53


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, place: np.ndarray, nodes: int, entries: np.ndarray) -> np.ndarray:
    """Fixed-point sums of g and h, an array (2, nodes, entries, BINS); ``place`` is each row's node, -1 if none."""
    kept = np.flatnonzero(place >= 0)
    out = np.zeros((2, nodes * len(entries) * BINS), np.int64)
    for some in np.array_split(kept, max(1, -(-len(kept) // 16_384))):  # weighted counts are exact below 2^53
        cell = ((place[some, None] * len(entries) + np.arange(len(entries))) * BINS + bins[np.ix_(some, entries)]).ravel()
        for k, v in enumerate((g, h)):
            out[k] += np.bincount(cell, np.repeat(np.rint(v[some] * UNIT), len(entries)), out.shape[1]).astype(np.int64)
    return out.reshape(2, nodes, len(entries), BINS)


def slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss."""
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def split(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry place or -1, bin, left sums, right sums) of each node: the split of most gain, the first of equals.

    Left and right sums are arrays (2, nodes) of gradient and curvature.
    """
    left = np.cumsum(sums, axis=3)[..., :-1] / UNIT
    total = sums[:, :, :1].sum(axis=3, keepdims=True) / UNIT
    right = total - left
    gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
    gain = np.where((left[1] >= LEAST) & (right[1] >= LEAST), gain, -1.0).reshape(sums.shape[1], -1)
    each, best = np.arange(len(gain)), gain.argmax(axis=1)
    place = np.where(gain[each, best] > 1e-9, best // (BINS - 1), -1)
    return place, best % (BINS - 1), *(side.reshape(2, len(each), -1)[:, each, best] for side in (left, right))


class Local:
    """The binned training rows of a small table."""

    def __init__(self, rows: DataFrame, start: float):
        got = rows.toArrow()
        self.bins, self.y, self.keys = _columns(got.combine_chunks().to_batches())
        self.margin = np.full(len(self.y), start)

    def sums(self, tree: Tree, first: int, nodes: np.ndarray, entries: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
        g, h = slopes(self.margin, self.y)
        place = _places(tree.leaves(self.bins), nodes, first, drawn(self.keys, round_, share, seed))
        return histograms(self.bins, g, h, place, len(nodes), entries)

    def add(self, tree: Tree) -> None:
        self.margin += tree.weight[tree.leaves(self.bins)]


class Spread:
    """The binned training rows of a large table: stored with their margins, summed by tasks."""

    def __init__(self, rows: DataFrame, start: float):
        self.rows, self.trees = self._stored(rows.withColumn("margin", F.lit(start))), []

    @staticmethod
    def _stored(rows: DataFrame) -> DataFrame:
        path = shared_path(rows.sparkSession, "boosting")
        rows.write.parquet(path)
        return rows.sparkSession.read.parquet(path)

    def sums(self, tree: Tree, first: int, nodes: np.ndarray, entries: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
        trees, shape = list(self.trees), (2, len(nodes), len(entries), BINS)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for b in batches:
                bins, y, keys = _columns([b])
                g, h = slopes(_margin(b, bins, trees), y)
                total += histograms(bins, g, h, _places(tree.leaves(bins), nodes, first, drawn(keys, round_, share, seed)), len(nodes), entries)
            flat = total.reshape(2, -1)
            cell = np.flatnonzero(flat.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[0, cell]), pa.array(flat[1, cell])], names=["cell", "g", "h"])

        parts = self.rows.mapInArrow(partial, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        got, out = parts.toArrow(), np.zeros((2, int(np.prod(shape[1:]))), np.int64)
        out[:, got["cell"].to_numpy()] = np.stack([got["g"].to_numpy(), got["h"].to_numpy()])
        return out.reshape(shape)

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        if len(self.trees) < STORE_EVERY:
            return
        trees = self.trees

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins, _, _ = _columns([b])
                yield pa.RecordBatch.from_arrays([b["bins"], b["y"], b["key"], pa.array(_margin(b, bins, trees))], names=["bins", "y", "key", "margin"])

        self.rows, self.trees = self._stored(self.rows.mapInArrow(margins, "bins binary, y int, key long, margin double")), []


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, y, keys) of batches with columns bins, y, key."""
    bins = np.frombuffer(b"".join(v for b in batches for v in b["bins"].to_pylist()), np.uint8)
    y = np.concatenate([b["y"].to_numpy() for b in batches]).astype(float)
    return bins.reshape(len(y), -1) if len(y) else bins.reshape(0, 1), y, np.concatenate([b["key"].to_numpy() for b in batches])


def _margin(batch: pa.RecordBatch, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    margin = np.array(batch["margin"].to_numpy())
    for tree in trees:
        margin += tree.weight[tree.leaves(bins)]
    return margin


def _places(leaves: np.ndarray, nodes: np.ndarray, first: int, sampled: np.ndarray) -> np.ndarray:
    """Each row's place among ``nodes`` of the level that starts at ``first``, -1 outside them and the sample."""
    where = np.full(first + 2, -1)  # node numbers of a level run from first to 2 first
    at = leaves - first
    inside = (at >= 0) & sampled
    where[nodes - first] = np.arange(len(nodes))
    return np.where(inside, where[np.where(inside, at, 0)], -1)


def binned(known: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(bins, y, key) of usable rows (x, y): entry by entry the number of cuts below the value.

    The key is a hash of the row, so equal rows are drawn together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = usable(b.column(0), len(cuts))
            bins = np.zeros(x.shape, np.uint8)
            for i, c in enumerate(cuts):
                bins[:, i] = np.searchsorted(c, x[:, i])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column(1), b.column(2)], names=["bins", "y", "key"])

    return known.select("x", "y", F.xxhash64("x", "y").alias("key")).mapInArrow(run, "bins binary, y int, key long")


def quantile_cuts(known: DataFrame) -> np.ndarray:
    """(width, BINS - 1) rising cuts; an entry of few values repeats them."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    entries = known.select(F.posexplode("x").alias("i", "v"))
    rows = entries.groupBy("i").agg(F.percentile_approx(F.col("v").cast("double"), shares, 10_000).alias("c")).collect()
    return np.array([r["c"] for r in sorted(rows, key=lambda r: r["i"])])


def grown(held: Local | Spread, width: int, round_: int, depth: int, rate: float, rows: float, columns: float, seed: int) -> Tree:
    """The next tree over bins, a pass a level; a root without a split has no weight."""
    taken = max(1, round(columns * width))
    entries = np.arange(width) if taken == width else np.sort(np.random.default_rng([seed, round_]).choice(width, taken, replace=False))
    tree, nodes = Tree.empty(depth), np.array([0])
    for level in range(depth):
        place, bin_, left, right = split(held.sums(tree, 2**level - 1, nodes, entries, round_, rows, seed))
        found = place >= 0
        if not found.any():
            break
        nodes = nodes[found]
        tree.entry[nodes], tree.cut[nodes] = entries[place[found]], bin_[found]
        children = np.concatenate([2 * nodes + 1, 2 * nodes + 2])
        g, h = np.concatenate([left[:, found], right[:, found]], axis=1)
        tree.weight[children] = -rate * g / (h + RIDGE)
        nodes = np.sort(children)
    return tree


def fit(train: DataFrame, depth: int, rounds: int, rate: float, rows: float, columns: float, seed: int, local_cells: int) -> tuple[int, float, list[Tree]]:
    """(width, start, trees over values): a margin is the start and the weights of the leaves; width 0 without usable rows."""
    whole = (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    known = train.where(F.col("y").isNotNull() & F.col("x").isNotNull() & whole).select("x", F.col("y").cast("int").alias("y"))
    width = known.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return 0, 0.0, []
    known = known.where(F.size("x") == width)
    n, ones = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    share = min(max(ones / n, 1e-6), 1 - 1e-6)
    start, cuts = float(np.log(share / (1 - share))), quantile_cuts(known)
    held = (Local if n * width <= local_cells else Spread)(binned(known, cuts), start)
    trees = []
    for round_ in range(rounds):
        tree = grown(held, width, round_, depth, rate, rows, columns, seed)
        held.add(tree)
        at = np.flatnonzero(tree.entry >= 0)
        values = np.zeros(len(tree.cut))
        values[at] = cuts[tree.entry[at], tree.cut[at].astype(int)]
        trees.append(tree._replace(cut=values))
    return width, start, trees


def boosted_trees(train: DataFrame, vectors: DataFrame, depth: int = 6, rounds: int = 300, rate: float = 0.1, rows: float = 1.0, columns: float = 1.0, seed: int = 17, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """P(attack) of every row of ``vectors``, from trees fitted on all rows of ``train`` (x, y with y 0 or 1).

    ``rows`` and ``columns`` are the shares of rows and entries that each tree sees.  A vector that is null, of another
    width than the widest usable one, or holds a null or non-finite entry is not learned from and scores null, and so
    does every row if nothing can be learned from.  Rows without a label are not learned from.
    """
    width, start, trees = fit(train, depth, rounds, rate, rows, columns, seed, local_cells)
    if not width:
        return unscored(vectors)

    def score(x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), start)
        for tree in trees:
            margin += tree.weight[tree.leaves(x)]
        return 1 / (1 + np.exp(-margin))

    return scored(vectors, score, width=width)
