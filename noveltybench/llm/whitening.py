"""Embedding whitening by a bidiagonal qd solver.

Vectors are put on an integer grid, so counts, sums and deviations are exact however
the rows are dealt.  Each task reduces its centred rows to one triangle by blockwise
QR; MERGERS tasks reduce those triangles, and the driver the MERGERS that remain.
Householder reflections make the triangle bidiagonal, dqds finds its squared singular
values to high relative accuracy, twisted factorisations give their right vectors, and
the reflections carry those back.  The driver holds matrices as wide as the vectors.

Defined cases: vectors that are null, empty, or hold a null, a non-finite or an
unholdable entry (its grid value is no long) are left out; so are vectors whose length
is not the commonest (of equally common ones the greatest).  Repeated rows and ids all
count; a null id stays.  A direction without variance is no component, so equal or too
few vectors give fewer components, or no rows at all; an empty table gives none.
A deviation beyond the range of a long is null.  The operators keep no other column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Tasks that merge triangles, rows of one QR block, and lengths a task counts before it sends them on.
MERGERS, BLOCK, LENGTHS = 32, 4_096, 64
EPS = float(np.finfo(float).eps)
#: Squares of couplings this small, against what they couple, are nothing.
NEGLIGIBLE = (8 * EPS) ** 2
#: Eigenvalues closer than this share are orthogonalised together.
CLOSE = 1e-3


def on_grid(column: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) of the usable vectors of each length in a list column."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(values * scale)
        bad = ~(np.abs(values) < 2.0**62)
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], np.cumsum(bad)])
    good = (sizes > 0) & (before[starts + sizes] == before[starts])
    for length in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == length))
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            yield some, values[starts[some][:, None] + np.arange(length)].astype(np.int64) + offset


def totals(df: DataFrame, vector: str, scale: int, offset: int) -> tuple[int, list[int]] | None:
    """Count and sums by dimension of the vectors of the commonest length; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}

        def rows() -> pa.RecordBatch:
            columns = zip(*[(length, at, n, h, w) for length, (n, high, low) in found.items() for at, (h, w) in enumerate(zip(high.tolist(), low.tolist(), strict=True))], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["length", "at", "n", "high", "low"])

        for batch in batches:
            for some, x in on_grid(batch.column(0), scale, offset):
                n, high, low = found.get(x.shape[1], (0, 0, 0))
                found[x.shape[1]] = [n + len(some), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
            if len(found) > LENGTHS:
                yield rows()
                found.clear()
        if found:
            yield rows()

    counted = df.select(vector).mapInArrow(run, "length long, at long, n long, high long, low long")
    summed = counted.groupBy("length", "at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    one = summed.groupBy("length").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "high", "low"))).alias("sums")).orderBy(F.desc("n"), F.desc("length")).first()
    return one and (one["n"], [(int(s["high"]) << 32) + int(s["low"]) for s in one["sums"]])


class Centre:
    """Exact distances from the mean: n * x - S as long (modulo 2**64), and x - S / n as double."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.length = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) squared; null where no long holds it.

        A sum that a long holds comes out right from arithmetic modulo 2**64; the double next to it tells which do.
        """
        about = (self.rows(x) ** 2).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            steps = (x - self.whole) * np.int64(self.n) - self.rest
            exact = (steps * steps).sum(axis=1)
        out = np.where(about < 2.0**63, exact.astype(object), None)
        for i in np.flatnonzero(np.abs(about / 2.0**63 - 1) < 1e-6):
            sure = sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(x[i] - self.whole, self.rest, strict=True))
            out[i] = sure if sure < 2**63 else None
        return out


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The R of all rows of the blocks, QR by QR."""
    r = np.zeros((0, width))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def triangles(df: DataFrame, vector: str, centre: Centre, scale: int, offset: int) -> np.ndarray:
    """R with R'R = the sum of outer products of the centred rows."""
    width, shared = centre.length, df.sparkSession.sparkContext.broadcast(centre)

    def sent(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((shared.value.rows(x) for b in batches for _, x in on_grid(b.column(0), scale, offset) if x.shape[1] == width), width)
        if len(r):
            yield sent(r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((np.frombuffer(v).reshape(-1, width) for b in batches for v in b.column(0).to_pylist()), width)
        if len(r):
            yield sent(r)

    found = df.select(vector).mapInArrow(reduce, "r binary").repartition(MERGERS).mapInArrow(merge, "r binary").collect()
    return triangle((np.frombuffer(row["r"]).reshape(-1, width) for row in found), width)


def reflection(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, factor, value): I - factor * v v' takes x to (value, 0, ..., 0)."""
    size = float(np.abs(x).max()) if len(x) else 0.0
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0, float(x[0]) if len(x) else 0.0
    v = x / size
    norm = math.copysign(float(np.sqrt(v @ v)), -v[0])
    v[0] -= norm
    return v, 2.0 / float(v @ v), norm * size


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal, superdiagonal and right reflections of the bidiagonal form of a square matrix."""
    b, n, right = np.array(r, float), len(r), []
    for k in range(n):
        v, factor, _ = reflection(b[k:, k])
        if factor:
            b[k:, k:] -= factor * np.outer(v, v @ b[k:, k:])
        if k < n - 1:
            v, factor, _ = reflection(b[k, k + 1 :])
            if factor:
                b[k:, k + 1 :] -= factor * np.outer(b[k:, k + 1 :] @ v, v)
            right.append((v, factor))
    return np.diag(b).copy(), np.diag(b, 1).copy(), right


def carried_back(vectors: np.ndarray, right: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Right vectors of the matrix from those (columns) of its bidiagonal form."""
    out = vectors.copy()
    for k in range(len(right) - 1, -1, -1):
        v, factor = right[k]
        if factor:
            out[k + 1 :] -= factor * np.outer(v, v @ out[k + 1 :])
    return out


def _shifted(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], int]:
    """One dqds transform; the place of the first negative d, or -1 if there is none."""
    nq, ne, d = [], [], q[0] - tau
    for i, coupling in enumerate(e):
        if d < 0:
            return nq, ne, i
        total = d + coupling
        t = q[i + 1] / total if total > 0 else 1.0
        nq.append(total)
        ne.append(coupling * t if total > 0 else 0.0)
        d = d * t - tau
    nq.append(d)
    return nq, ne, len(e) if not d >= 0 else -1


def _lower_bound(q: list[float], e: list[float]) -> float:
    """1 / trace of the inverse, from the transform without a shift: never above the least eigenvalue."""
    d, total = q[0], 0.0
    for i in range(len(q)):
        if d <= 0:
            return 0.0
        total += 1 / d
        if i < len(e):
            d = q[i + 1] * (d / (d + e[i]))
    return (1 - 4 * len(q) * EPS) / total if total < math.inf else 0.0


def _corner(q: list[float], e: list[float]) -> tuple[float, float]:
    """Eigenvalues of a 2 x 2 qd array."""
    trace, gap = q[0] + e[0] + q[1], q[0] - q[1] + e[0]
    high = (trace + math.sqrt(gap * gap + 4 * q[1] * e[0])) / 2
    return high, q[0] * (q[1] / high) if high > 0 else 0.0


def qd_values(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values, falling, of the bidiagonal whose squared entries are ``q`` and ``e``: dqds.

    The shift is the least eigenvalue of the last corner; where only the last d turns out negative, shift + d is a bound
    close to the least eigenvalue, and elsewhere the trace of the inverse gives a safe one.
    """
    out, blocks = [], [(list(q), list(e), 0.0)]
    while blocks:
        q, e, sigma = blocks.pop()
        lost = 0.0  # what sigma's additions left out
        if len(q) > 2 and q[0] * 1.5 < q[-1]:
            q, e = q[::-1], e[::-1]
        while q:
            while len(q) > 1 and e[-1] <= NEGLIGIBLE * (sigma + q[-1]):
                out.append(q.pop() + sigma)
                e.pop()
            if len(q) == 1:
                out.append(q[0] + sigma)
                break
            if len(q) == 2:
                out.extend(v + sigma for v in _corner(q, e))
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= NEGLIGIBLE * max(sigma, q[i])), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], sigma))
                blocks.append((q[cut + 1 :], e[cut + 1 :], sigma))
                break
            tau = _corner(q[-2:], e[-1:])[1]
            nq, ne, failed = _shifted(q, e, tau)
            if failed == len(e) and nq[-1] + tau > 0:
                tau = (tau + nq[-1]) * (1 - 2 * EPS)
                nq, ne, failed = _shifted(q, e, tau)
            if failed >= 0:
                tau = _lower_bound(q, e)
                nq, ne, failed = _shifted(q, e, tau)
            while failed >= 0:  # only by rounding
                tau = tau / 2 if tau > EPS * q[-1] else 0.0
                nq, ne, failed = _shifted(q, e, tau)
            q, e = nq, ne
            added = tau + lost
            sigma, lost = sigma + added, added - ((sigma + added) - sigma)
    return sorted(out, reverse=True)


class Twisted:
    """Twisted factorisations N D N' of B'B - value, B bidiagonal with diagonal a and superdiagonal b."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n, off = len(a), (a[:-1] * b).tolist()
        q, e = (a * a).tolist(), (b * b).tolist()
        tiny = (EPS * EPS) * max(max(q), max(e, default=0.0), 1e-300)
        s, p = -value, q[-1] - value
        self.down, self.lower, above = [0.0] * n, [0.0] * (n - 1), [s] * n
        for i in range(n - 1):  # stationary, from the top
            d = s + q[i]
            d = d if abs(d) > tiny else -tiny
            self.down[i], self.lower[i] = d, off[i] / d
            s = above[i + 1] = e[i] * (s / d) - value
        self.down[-1] = s + q[-1]
        self.up, self.upper, below = [0.0] * n, [0.0] * (n - 1), [p] * n
        for i in range(n - 2, -1, -1):  # progressive, from the bottom
            d = e[i] + p
            d = d if abs(d) > tiny else -tiny
            self.up[i + 1], self.upper[i] = d, off[i] / d
            p = below[i] = q[i] * (p / d) - value
        self.twist = [x + y + value for x, y in zip(above, below, strict=True)]
        self.place = min(range(n), key=lambda i: abs(self.twist[i]))
        self.tiny = tiny

    def null_vector(self) -> tuple[np.ndarray, float]:
        """Unit vector nearly in the null space, and the correction of the value that it suggests."""
        n, r = len(self.twist), self.place
        z = [0.0] * n
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -self.lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -self.upper[i] * z[i]
        z = np.array(z)
        norm = float(np.sqrt(z @ z))
        return z / norm, self.twist[r] / norm**2

    def solve(self, y: np.ndarray) -> np.ndarray:
        """A unit vector along the solution of (B'B - value) z = y."""
        n, r, z = len(y), self.place, y.astype(float).tolist()
        for i in range(r):
            z[i + 1] -= self.lower[i] * z[i]
        for i in range(n - 2, r - 1, -1):
            z[i] -= self.upper[i] * z[i + 1]
        pivot = self.twist[r] if abs(self.twist[r]) > self.tiny else self.tiny
        z = [v / d for v, d in zip(z, [*self.down[:r], pivot, *self.up[r + 1 :]], strict=True)]
        for i in range(r - 1, -1, -1):
            z[i] -= self.lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] -= self.upper[i] * z[i]
        z = np.array(z) / np.abs(z).max()
        return z / np.sqrt(z @ z)


def _vectors(a: np.ndarray, b: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for falling eigenvalues; those that are close are made orthogonal."""
    out: list[np.ndarray] = []
    rng = np.random.default_rng(len(a))
    group = 0  # where the run of close values begins
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * values[k - 1]:
            group = k
        found = Twisted(a, b, value)
        z, shift = found.null_vector()
        if abs(shift) > EPS * value and abs(shift) < CLOSE / 10 * value:
            better = Twisted(a, b, value + shift)
            z2, shift2 = better.null_vector()
            if abs(shift2) < abs(shift):
                found, z = better, z2
        near = np.array(out[group:]).T if k > group else None
        for _ in range(4):
            if near is None:
                break
            rest = z - near @ (near.T @ z)
            rest -= near @ (near.T @ rest)
            norm = float(np.sqrt(rest @ rest))
            if norm > 0.7:
                z = rest / norm
                break
            start = rng.normal(size=len(a))  # the same vector again: another start, away from those found
            start -= near @ (near.T @ start)
            z = found.solve(start)
        if near is not None:
            z = z - near @ (near.T @ z)
            z /= np.sqrt(z @ z)
        out.append(z)
    return np.array(out).T


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of ``r``, ``most`` at most, and their right vectors (columns).

    Values that are nil to rounding are left out.  The largest entry of a vector is positive.
    """
    width = r.shape[1]
    size = float(np.abs(r).max()) if r.size else 0.0
    if size == 0:
        return np.zeros(0), np.zeros((width, 0))
    square = np.zeros((max(r.shape), width))
    square[: len(r)] = r / size
    square = np.linalg.qr(square, mode="r") if len(square) > width else square
    a, b, right = bidiagonal(square)
    big = max(np.abs(a).max(), np.abs(b).max() if len(b) else 0)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * EPS * big) + 1).tolist(), width]
    found = []  # (value, first, last) of each block
    for first, last in zip(cuts, cuts[1:], strict=False):
        found += [(v, first, last) for v in qd_values((a[first:last] ** 2).tolist(), (b[first : last - 1] ** 2).tolist())]
    found.sort(key=lambda f: -f[0])
    least = found[0][0] * (16 * width * EPS) ** 2
    found = [f for f in found[:most] if f[0] > least]
    vectors = np.zeros((width, len(found)))
    for first, last in {f[1:] for f in found}:
        of = [i for i, f in enumerate(found) if f[1:] == (first, last)]
        vectors[first:last, of] = _vectors(a[first:last], b[first : last - 1], [found[i][0] for i in of])
    vectors = carried_back(vectors, right)
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(found))] < 0, -1.0, 1.0)
    return np.array([f[0] for f in found]) * size * size, vectors


class Whitening:
    """Mean, components and eigenvalues; as wide as the vectors."""

    def __init__(self, centre: Centre, r: np.ndarray, components: int, scale: int, offset: int):
        values, vectors = principal(r, components)
        self.centre, self.scale, self.offset = centre, scale, offset
        self.values, self.vectors = values / centre.n, vectors
        self.explained = self.values / (float((r * r).sum()) / centre.n) if len(values) else self.values
        self.directions = vectors / np.sqrt(self.values)

    def of(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, grid vectors, whitened vectors) of the usable vectors of a batch."""
        for rows, x in on_grid(column, self.scale, self.offset):
            if x.shape[1] == self.centre.length:
                yield rows, x, self.centre.rows(x) @ self.directions


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """Fitted on all usable vectors; None without any."""
    found = totals(df, vector, scale, offset)
    if found is None:
        return None
    centre = Centre(*found)
    return Whitening(centre, triangles(df, vector, centre, scale, offset), components, scale, offset)


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding", out: str = "whitened") -> DataFrame:
    """key and whitened vector (array<double>) of each usable row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if shared.value else ():
            for rows, _, w in shared.value.of(batch.column(1)):
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(w.shape[1], 1))[: len(w) + 1] if w.shape[1] else np.zeros(len(w) + 1), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), vectors], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, `{out}` array<double>")


def identity_error(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> float:
    """The largest entry, without sign, of the whitened vectors' covariance minus the identity."""
    size = len(model.values) if model else 0
    if not size:
        return 0.0
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            for _, _, w in shared.value.of(batch.column(0)):
                total[:size] += w.T @ w
                total[size] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    rows = df.select(vector).mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((size + 1) * size)
    for row in rows:
        total[row["at"]] = row["value"]
    total = total.reshape(size + 1, size) / model.centre.n
    return float(np.abs(total[:size] - np.outer(total[size], total[size]) - np.eye(size)).max())


def digest(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a usable vector and component."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(rows, components=components)
    error = identity_error(rows, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if shared.value else ():
            for of, x, w in shared.value.of(batch.column(1)):
                n, k = w.shape
                columns = [
                    batch.column(0).take(pa.array(np.repeat(of, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, shared.value.centre.n, np.int64)),
                    pa.array(shared.value.centre.deviations(x).tolist(), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(shared.value.explained, n)),
                    pa.array(np.full(n * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
