"""Whitening of embeddings: streaming covariance by rank-one updates, merged across partitions, and a QR eigen-solve.

Each partition iterator updates a mean and a matrix of centred products by one vector after another (Welford);
two such states merge by the parallel update formula, in rounds that take ``MERGED`` states into one task, so
no task ever holds more than a few matrices. Only the last one, of dimension by dimension, comes to the driver,
where Householder reflections make it tridiagonal and implicitly shifted QR steps diagonal.

Entries are whole numbers, so that sums are exact whatever the order; the covariance is in double precision.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

SCALE, SHIFT, MOST = 64, 1_000_000, 16
MERGED = 32
#: Entries beyond this have no whole number to stand for them.
LARGEST = float(1 << 62)
#: Axes of less than this share of the largest one's variance are rounding noise and have no unit variance to give.
NOISE = 1e-12

_STATE = "dim int, slot long, n long, sums array<decimal(38,0)>, mean array<double>, products array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its entries are finite and have a whole number; false for none."""
    whole = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * SCALE) < LARGEST), F.lit(False)))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def whole(vector: Column) -> Column:
    """Each entry c as the whole number floor(64 c) + 1000000."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


class State:
    """Count, exact sums, mean and centred products of the vectors seen so far."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, np.zeros(dim, object)
        self.mean, self.products = np.zeros(dim), np.zeros((dim, dim))

    def add(self, vectors: np.ndarray) -> None:
        """Rank-one updates by some vectors, one after another."""
        delta, step = np.empty_like(self.mean), np.empty_like(self.products)
        for v in vectors.astype(np.float64):
            self.n += 1
            np.subtract(v, self.mean, out=delta)
            self.mean += delta / self.n
            np.multiply(delta[:, None], (delta * ((self.n - 1) / self.n))[None, :], out=step)
            self.products += step

    def add_whole(self, vectors: np.ndarray) -> None:
        """As :meth:`add`, and sums in two halves that cannot overflow."""
        low, high = (vectors & 0xFFFFFFFF).sum(0), (vectors >> 32).sum(0)
        self.sums = self.sums + low.astype(object) + high.astype(object) * (1 << 32)
        self.add(vectors)

    def merge(self, n: int, sums: np.ndarray, mean: np.ndarray, products: np.ndarray) -> None:
        """The parallel update formula."""
        total, delta = self.n + n, mean - self.mean
        self.products += products + np.outer(delta, delta) * (self.n * n / total)
        self.mean += delta * (n / total)
        self.n, self.sums = total, self.sums + sums


def _rows(states: dict[int, State], slot: int) -> Iterator[pa.RecordBatch]:
    for dim, s in states.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([dim], pa.int32()), pa.array([slot], pa.int64()), pa.array([s.n], pa.int64()), pa.array([list(map(int, s.sums))], pa.list_(pa.decimal128(38, 0))),
                pa.array([s.mean.tolist()], pa.list_(pa.float64())), pa.array([s.products.ravel().tolist()], pa.list_(pa.float64())),
            ],
            names=["dim", "slot", "n", "sums", "mean", "products"],
        )


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a list column."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), size.cumsum()
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)[None, :]]


def merged(rows: DataFrame, whole_numbers: bool) -> dict[int, State]:
    """The state of all vectors of each length in a column ``x``: one for each partition, merged in rounds."""

    def start(batches):
        states: dict[int, State] = {}
        for batch in batches:
            for _, vectors in by_dimension(batch.column(0)):
                state = states.setdefault(vectors.shape[1], State(vectors.shape[1]))
                (state.add_whole if whole_numbers else state.add)(vectors)
        yield from _rows(states, TaskContext.get().partitionId())

    def join(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        state = State(rows[0]["dim"])
        for r in rows:
            state.merge(r["n"], np.array(list(map(int, r["sums"])), object), np.array(r["mean"]), np.array(r["products"]).reshape(r["dim"], r["dim"]))
        return pa.Table.from_batches(_rows({rows[0]["dim"]: state}, rows[0]["slot"]))

    states = written(rows.select("x").mapInArrow(start, _STATE), "states")
    while (most := states.agg(F.max("slot")).first()[0] or 0) > 0:
        grouped = states.withColumn("slot", F.floor(F.col("slot") / MERGED).cast("long")).groupBy("dim", "slot")
        states = written(grouped.applyInArrow(join, _STATE), "states")
        if most < MERGED:
            break
    out = {}
    for r in states.collect():  # one row for each length
        state = out[r["dim"]] = State(r["dim"])
        state.n, state.sums, state.mean = r["n"], np.array(list(map(int, r["sums"])), object), np.array(r["mean"])
        state.products = np.array(r["products"]).reshape(r["dim"], r["dim"])
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with matrix = q T q': Householder reflections of one column after another."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        if size == 0 or not np.abs(v[1:]).max(initial=0.0):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.sqrt(v @ v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, by implicitly shifted QR steps."""
    n = len(matrix)
    scale = np.abs(matrix).max(initial=0.0)
    if not scale:
        return np.zeros(n), np.eye(n)
    d, e, q = tridiagonal((matrix + matrix.T) / (2 * scale))
    vectors, hi, tiny = q.T.copy(), n - 1, np.finfo(float).eps
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        zero = np.flatnonzero(small)
        lo = int(zero[-1]) + 1 if len(zero) else 0
        # The shift is the eigenvalue of the last two by two block that is closer to its last entry.
        g = (d[hi - 1] - d[hi]) / 2
        mu = d[hi] - e[hi - 1] ** 2 / (g + np.copysign(np.hypot(g, e[hi - 1]), g))
        x, z = d[lo] - mu, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a, b, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a + 2 * c * s * f + s * s * b, s * s * a - 2 * c * s * f + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * f
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            vectors[[k, k + 1]] = c * vectors[k] + s * vectors[k + 1], c * vectors[k + 1] - s * vectors[k]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, vectors[order].T


class Axes:
    """What whitens the vectors of one length: ``n``, exact ``sums``, ``axes`` as columns over their deviations, shares of the variance."""

    def __init__(self, state: State, most: int = MOST):
        self.n, self.sums = state.n, state.sums
        covariance = state.products / state.n
        values, vectors = eigen(covariance)
        trace = float(np.trace(covariance))
        many = min(most, int((values > NOISE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0)
        self.axes = vectors[:, :many] / np.sqrt(values[:many])
        self.explained = values[:many] / trace if trace else values[:many]
        self.identity_error = 0.0

    def deviations(self, vectors: np.ndarray) -> np.ndarray:
        """n x - S, exact: as 64-bit numbers where they surely fit, else as Python's."""
        most = max(int(np.abs(vectors).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if most < 1 << 61:
            return vectors * self.n - self.sums.astype(np.int64)
        return vectors.astype(object) * self.n - self.sums

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Coordinates on the axes, of unit variance over the fit list."""
        return (deviations / self.n).astype(np.float64) @ self.axes

    @staticmethod
    def squares(deviations: np.ndarray) -> list[int | None]:
        """The exact sum of squares of each row; None where it does not fit a long."""
        if deviations.dtype != object and (most := int(np.abs(deviations).max(initial=0))) ** 2 * deviations.shape[1] < 1 << 63:
            return (deviations**2).sum(1).tolist()
        return [x if (x := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in deviations]


def fit(vectors: DataFrame, vector: str = "embedding", most: int = MOST) -> dict[int, Axes]:
    """The axes for the vectors of each length in a table, each distinct vector counted once.

    ``identity_error`` is measured by a second streaming pass over the whitened vectors.
    """
    x = vectors.where(usable(F.col(f"`{vector}`"))).select(whole(F.col(f"`{vector}`")).alias("x"))
    distinct = written(x.distinct(), "distinct")
    found = {dim: Axes(state, most) for dim, state in merged(distinct, True).items()}
    held = vectors.sparkSession.sparkContext.broadcast(found)

    def project(batches):
        for batch in batches:
            for _, some in by_dimension(batch.column(0)):
                axes = held.value[some.shape[1]]
                if axes.axes.shape[1]:
                    y = axes.whitened(axes.deviations(some))
                    yield pa.RecordBatch.from_arrays([pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(np.full(len(y), some.shape[1], np.int32))], names=["x", "dim"])

    for dim in found:
        rows = distinct.mapInArrow(project, "x array<double>, dim int").where(F.col("dim") == dim)
        for state in merged(rows, False).values():
            found[dim].identity_error = float(np.abs(state.products / state.n - np.eye(len(state.mean))).max())
    return found


def whitened(vectors: DataFrame, axes: dict[int, Axes], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable vector and component."""
    source = vectors.where(usable(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("key"), whole(F.col(f"`{vector}`")).alias("x"))
    held = vectors.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for batch in batches:
            for rows, some in by_dimension(batch.column(1)):
                axes = held.value[some.shape[1]]
                many = axes.axes.shape[1]
                deviations = axes.deviations(some)
                total = len(rows) * many
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, many))), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(rows))), pa.array(np.full(total, axes.n)),
                        pa.array(axes.squares(deviations), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), many))), pa.array(axes.whitened(deviations).ravel()),
                        pa.array(np.tile(axes.explained, len(rows))), pa.array(np.full(total, axes.identity_error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """:func:`fit` and :func:`whitened` for one table: a row for each usable vector and each of up to ``most`` components.

    Vectors that are null or empty, or hold entries that are null, not finite or beyond 2^62 / 64, have no rows.
    Vectors of another length are fitted by themselves. An axis without variance has no row: one distinct vector
    gives none. Equal vectors count once in the fit and each has its rows; equal or null keys are kept as they
    are. ``deviation`` is null where the exact sum does not fit a long. No rows give no rows; other columns are
    not read.
    """
    return whitened(vectors, fit(vectors, vector, most), key, vector)
