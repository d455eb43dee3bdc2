"""Whitening of embeddings by a Jacobi-Davidson eigensolver whose only view of the data are distributed products.

The covariance is never formed. A product takes a few vectors b to (1/n) sum (x - mean)((x - mean)'b): every task centres
its rows and adds up its share, and the shares, one small matrix a task, are added. The solver keeps a small search space on
the driver: Rayleigh-Ritz inside it gives the leading pairs; pairs whose residual is at rounding level are locked and
deflated; for each of the others a correction equation, projected off the locked and present vectors, is solved roughly by a
few MINRES steps, all columns in the same product; the corrections enlarge the space, which is cut back to its best vectors
when it is full. It ends when all residuals are at rounding level, and raises if they do not get there.

The rows are kept as blocks of whole numbers, so the sums are exact and a pass is one read of the blocks. What reaches the
driver has the size of a few vectors a task, added up by groups of tasks first where there are many.

Defined results: a row is dropped if its vector is null, or holds a null or non-finite entry (or one beyond 2 ** 52, which has no
long), or is not as long as most vectors (of equally frequent lengths, the longest counts); rows that repeat an id each
have their results; components without variance are left out, as there is nothing to scale; ``deviation`` is null where it is
beyond a long; a table with no rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from propspark.llm.common import stored

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 52
BLOCK_BYTES = 4 << 20
MERGE_TASKS = 64  # beyond so many tasks their shares are added up in as many groups first
INNER = 4, 12  # MINRES steps of a correction: far from the vectors, near them
NEAR = 1e-4
SPACE = 96  # largest search space
ROUNDING = 32 * 2.0 ** -53  # a residual at rounding level, in units of the largest eigenvalue times the root of the size


def scaled(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part; x: the vector's entries as longs."""
    entry = lambda c: c.cast("double")
    fine = rows.where(rows[vector].isNotNull() & F.forall(
        rows[vector], lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) <= LARGEST)))
    x = fine.select(fine[vec_id].alias("vec_id"), F.transform(fine[vector], lambda c: F.floor(entry(c) * SCALE) + SHIFT).alias("x"))
    x = stored(x)
    usual = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, d)


class Vectors:
    """The fit list as stored blocks, its size n, exact sums and centre."""

    def __init__(self, x: DataFrame):
        first = x.select(F.size("x").alias("d")).first()
        self.d = d = first["d"] if first else 0
        rows = max(1, BLOCK_BYTES // (8 * max(1, d)))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _matrix(b.column(0), d)
                for at in range(0, len(m), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([m[at:at + rows].tobytes()], pa.binary())], ["data"])

        if d:
            self.blocks = stored(x.select("x").mapInArrow(blocks, "data binary"))
            self.tasks = self.blocks.rdd.getNumPartitions()
        # Sums of high and low halves, which cannot leave a long.
        sums = self._sums(lambda m: np.stack([np.full(d, len(m)), (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)]), (3, d), np.int64) if d else None
        self.n = int(sums[0][0]) if d else 0
        self.total = [(int(hi) << 32) + int(lo) for hi, lo in zip(sums[1], sums[2])] if d else []
        self.base = np.array([s // self.n for s in self.total], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.total])

    def _sums(self, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind=np.float64) -> np.ndarray:
        """The sum of ``share(block)`` over all blocks."""
        d = self.d

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shape, kind)
            for b in batches:
                for data in b.column(0):
                    held += share(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["data"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shape, kind)
            for b in batches:
                for data in b.column(0):
                    held += np.frombuffer(data.as_buffer(), kind).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["data"])

        shares = self.blocks.mapInArrow(add, "data binary")
        if self.tasks > MERGE_TASKS:
            shares = shares.repartition(MERGE_TASKS).mapInArrow(merge, "data binary")
        return sum(np.frombuffer(r["data"], kind).reshape(shape) for r in shares.collect())

    def centred_sums(self, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        base, rest = self.base, self.rest
        return self._sums(lambda m: share((m - base) - rest), shape)

    def product(self, b: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``b``."""
        return self.centred_sums(lambda c: c.T @ (c @ b), b.shape) / self.n

    def trace(self) -> float:
        return float(self.centred_sums(lambda c: (c * c).sum(axis=0), (self.d,)).sum()) / self.n


def _orthonormal(b: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``b`` off the orthonormal ``against``; dependent ones are left out."""
    kept = against
    for k in range(b.shape[1]):
        v = b[:, k]
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
        if size > 0 and np.linalg.norm(v) > 1e-10 * size:
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept[:, against.shape[1]:]


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float = 1e-2) -> np.ndarray:
    """Approximate solutions of product(t) = right, every column by its own MINRES recurrence, all in one product a step."""
    size = np.linalg.norm(right, axis=0)
    beta = np.where(size > 0, size, 1.0)
    v_old, v = np.zeros_like(right), right / beta
    phi = size.copy()
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    c, s, c_old, s_old = np.ones_like(size), np.zeros_like(size), np.ones_like(size), np.zeros_like(size)
    t, beta = np.zeros_like(right), np.zeros_like(size)
    for _ in range(steps):
        w = product(v) - beta * v_old
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v
        after = np.linalg.norm(w, axis=0)
        eps, bar = s_old * beta, c_old * beta
        delta, bar = c * bar + s * alpha, c * alpha - s * bar
        rho = np.hypot(bar, after)
        live = rho > 0
        rho = np.where(live, rho, 1.0)
        d_old, d = d, (v - eps * d_old - delta * d) / rho
        c_old, s_old, c, s = c, s, np.where(live, bar / rho, 1.0), np.where(live, after / rho, 0.0)
        t = t + np.where(live, c * phi, 0.0) * d
        phi = s * phi
        if (np.abs(phi) <= enough * size).all():
            break
        v_old, v, beta = v, w / np.where(after > 0, after, 1.0), after
    return t


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 7, limit: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric operator of size ``d`` that
    is given by its products with blocks of vectors."""
    wanted = min(wanted, d)
    locked = np.zeros((d, 0))
    space = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, 2 * wanted))), locked)
    image = product(space)
    top = 0.0
    for _ in range(limit):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        space, image = space @ turn, image @ turn
        top = max(top, float(values[0]))
        open_ = wanted - locked.shape[1]
        residual = image[:, :open_] - space[:, :open_] * values[:open_]
        residual -= locked @ (locked.T @ residual)
        small = np.linalg.norm(residual, axis=0) <= ROUNDING * d ** 0.5 * top
        done = int(np.argmin(small)) if not small.all() else open_  # in order: a larger one may still be on its way
        if done:
            locked = np.column_stack([locked, space[:, :done]])
            space, image, values, residual = space[:, done:], image[:, done:], values[done:], residual[:, done:]
            open_ -= done
        if not open_:
            break
        if space.shape[1] + locked.shape[1] >= d:  # nothing is left to add; take the residuals from the vectors anew
            space = _orthonormal(space, locked)
            image = product(space)
            continue
        if space.shape[1] + open_ > max(SPACE, 4 * wanted):
            space = _orthonormal(space[:, :2 * wanted], locked)
            image = product(space)  # anew, as rounding adds up in a turned image
            continue
        off = np.column_stack([locked, space[:, :open_]])
        shift = values[:open_]

        def projected(b: np.ndarray) -> np.ndarray:
            b = b - off @ (off.T @ b)
            b = product(b) - b * shift
            return b - off @ (off.T @ b)

        steps = INNER[int(np.linalg.norm(residual, axis=0).max() <= NEAR * top)]
        more = _orthonormal(minres(projected, -(residual - off @ (off.T @ residual)), steps), np.column_stack([locked, space]))
        if not more.shape[1]:
            more = _orthonormal(residual, np.column_stack([locked, space]))
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(seed + 1).standard_normal((d, open_)), np.column_stack([locked, space]))
        space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])
    else:
        raise RuntimeError("the residuals did not reach rounding level")
    # One more Rayleigh-Ritz step inside the locked space.
    image = product(locked)
    h = locked.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], locked @ turn[:, order]


def components(vectors: Vectors, wanted: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, eigenvectors and the trace; components whose variance is rounding only are left out."""
    if not vectors.n:
        return np.zeros(0), np.zeros((vectors.d, 0)), 0.0
    trace = vectors.trace()
    if trace <= 0:
        return np.zeros(0), np.zeros((vectors.d, 0)), 0.0
    values, basis = jacobi_davidson(vectors.product, vectors.d, wanted)
    real = values > 1e-12 * trace
    basis = basis[:, real]
    # Either sign would do; the largest entry is positive, so that runs agree.
    sign = np.sign(basis[np.argmax(np.abs(basis), axis=0), np.arange(basis.shape[1])])
    return values[real], basis * sign, trace


def identity_error(vectors: Vectors, scale: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; ``scale`` whitens centred rows."""
    k = scale.shape[1]
    if not k:
        return 0.0
    mean = vectors.centred_sums(lambda c: (c @ scale).sum(axis=0), (k,)) / vectors.n

    def share(c: np.ndarray) -> np.ndarray:
        w = c @ scale - mean
        return w.T @ w

    return float(np.abs(vectors.centred_sums(share, (k, k)) / vectors.n - np.eye(k)).max())


def whiten(rows: DataFrame, wanted: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every remaining row and component."""
    x = scaled(rows)
    vectors = Vectors(x)
    values, basis, trace = components(vectors, wanted)
    scale = basis / np.sqrt(values)
    error = identity_error(vectors, scale)
    k, n, d, total, base, rest = len(values), vectors.n, vectors.d, vectors.total, vectors.base, vectors.rest
    explained = values / trace if k else values

    def deviations(m: np.ndarray) -> pa.Array:
        """Exact; whole numbers of any size where longs might not do."""
        far = float(np.abs((m - base) - rest).max(initial=0)) * n
        if far * far * d < 2.0 ** 62 and n * float(np.abs(m).max(initial=0)) < 2.0 ** 62 and max(map(abs, total)) < 2 ** 62:
            off = m * n - np.array(total, np.int64)
            return pa.array((off * off).sum(axis=1))
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in m]
        return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), d)
            who = np.repeat(np.arange(len(m)), k)
            whitened = (((m - base) - rest) @ scale).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(who)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(who), n)),
                 deviations(m).take(pa.array(who)), pa.array(whitened), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(who), error))], names)

    schema = T.StructType([x.schema["vec_id"], *(T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])
    names = schema.names
    return x.mapInArrow(project, schema) if k else x.sparkSession.createDataFrame([], schema)
