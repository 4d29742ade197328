"""Whitening of embeddings by Jacobi-Davidson eigenvectors of their covariance.

Vectors become whole numbers, ``floor(256 * c)``. The fit list holds each distinct vector once and is written to the shared checkpoint
folder. The covariance is never formed: a product ``V q`` is one pass over the list, in which every task centres its rows, multiplies
twice and hands in one partial sum per dimension; Spark adds these up. What reaches the driver is ``dimensions x BLOCK`` numbers a pass,
whatever the number of rows.

Solver (:func:`jacobi_davidson`). The leading Ritz pairs of a search space are improved together: each has a correction equation, projected
on the complement of all of them and of the locked pairs, which MINRES solves in step, so one pass serves all. The corrections widen the
space, Rayleigh-Ritz follows, and leading pairs whose residual is down to the rounding of a product are locked and leave the space. A
full space restarts from its best pairs. When all are locked, random Krylov blocks probe the rest of the space; a larger value
there puts locked pairs back and the search goes on. It ends after at most ``OUTER`` rounds, with an error if a residual is still above :data:`LOOSE`.

Defined results: null vectors, vectors with null or non-finite entries and vectors of another length than most vectors (ties: the longest)
have no rows; components without variance (an eigenvalue under ``FLAT`` of the trace) are left out, so a table of equal
vectors, one vector or none gives no rows, and fewer dimensions give fewer components; repeated rows are scored each and fitted once; an entry whose 256-fold is
outside the range of a long counts as the nearest long; a deviation beyond a long is null; columns named as in :data:`ADDED` are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.session import materialize

COMPONENTS = 4
SCALE = 256.0
#: Columns multiplied in one pass.
BLOCK = 4
#: Largest search space, and what a restart keeps.
SPACE, KEPT = 64, 16
#: MINRES steps of a correction equation, rounds, and probing blocks at the end.
INNER, OUTER, PROBES = 6, 300, 6
#: A residual at the level of rounding is at most so many times the number of dimensions x machine epsilon x the largest eigenvalue;
#: one that no longer falls is taken below ``LOOSE`` x the largest eigenvalue.
SHARP, LOOSE = 8.0, 1e-11
FLAT = 1e-12
X = "_w_x"
ADDED = T.StructType(
    [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
)
_LONG = np.iinfo(np.int64)


def whole(vector: str | Column) -> Column:
    """``floor(256 * c)`` of every entry; null for a vector that takes no part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(v, lambda c: F.floor(F.lit(SCALE) * c.cast("double"))))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int) -> Callable:
    """Exact sums of the dimensions, and the number of rows as dimension -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, object), 0
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            if len(x) and max(abs(int(x.max())), abs(int(x.min()))) < (1 << 62) // len(x):
                total += x.sum(0).astype(object)
            else:
                total += x.astype(object).sum(0) if len(x) else 0
        if n:
            values = [Decimal(int(t)) for t in total] + [Decimal(n)]
            dims = pa.array([*range(d), -1], pa.int32())
            yield pa.record_batch([dims, pa.array(values, pa.decimal128(38, 0))], names=["dim", "total"])

    return run


class Covariance:
    """The covariance of a fit list as an operator: :meth:`times` is one distributed pass."""

    def __init__(self, fit: DataFrame, d: int):
        self.fit, self.d, self.passes = fit, d, 0
        found = fit.mapInArrow(_sums(d), "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
        sums = {r.dim: int(r.total) for r in found.collect()}  # dimensions + 1 rows
        self.n = sums.pop(-1, 0)
        self.sums = [sums.get(i, 0) for i in range(d)]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(d)

    def times(self, q: np.ndarray) -> np.ndarray:
        """``V q`` for a block of columns."""
        return np.hstack([self._block(q[:, a : a + BLOCK])[0] for a in range(0, q.shape[1], BLOCK)])

    def trace(self) -> float:
        return self._block(np.zeros((self.d, 1)))[1]

    def _block(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        self.passes += 1
        d, mean, width = self.d, self.mean, q.shape[1]
        q = np.hstack([q, np.zeros((d, BLOCK - width))])
        names = [f"c{i}" for i in range(BLOCK)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            product, squares, any_row = np.zeros((d, BLOCK)), np.zeros(d), False
            for b in batches:
                x = _matrix(b.column(0), d) - mean
                any_row |= len(x) > 0
                squares += np.einsum("ij,ij->j", x, x)
                product += x.T @ (x @ q)
            if any_row:
                columns = [pa.array(np.arange(d), pa.int32()), pa.array(squares), *(pa.array(np.ascontiguousarray(c)) for c in product.T)]
                yield pa.record_batch(columns, names=["dim", "squares", *names])

        schema = ", ".join(["dim int", "squares double", *(f"{c} double" for c in names)])
        parts = self.fit.mapInArrow(run, schema).groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("squares", *names)])
        out, squares = np.zeros((d, BLOCK)), 0.0
        for r in parts.collect():  # one row per dimension
            out[r[0]] = r[2:]
            squares += r[1]
        n = max(1, self.n)
        return out[:, :width] / n, squares / n


def _orthonormal(z: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of ``z`` made orthonormal and orthogonal to ``against``; columns without anything new go."""
    out = np.zeros((len(z), 0))
    for c in z.T:
        size = np.linalg.norm(c)
        if not np.isfinite(size) or size == 0:
            continue
        c = c / size
        for _ in range(3):  # one projection leaves rounding behind when little of c remains
            for a in (*against, out):
                c = c - a @ (a.T @ c)
            left = np.linalg.norm(c)
            if left < 1e-10:
                break
            c = c / left
        if left >= 1e-10:
            out = np.column_stack([out, c])
    return out


def minres(apply: Callable, b: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Independent symmetric systems, one per column, solved in step: ``apply`` multiplies all columns at once.

    A column stops when its residual is under ``goal`` of its right side, all stop after ``steps`` products.
    """
    first = np.linalg.norm(b, axis=0)
    live = first > 0
    v = np.divide(b, first, out=np.zeros_like(b), where=live)
    before, x = np.zeros_like(b), np.zeros_like(b)
    w1, w2 = np.zeros_like(b), np.zeros_like(b)
    k = b.shape[1]
    cos1, cos2, sin1, sin2 = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    beta, rest = np.zeros(k), first.copy()
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * before
        following = np.linalg.norm(p, axis=0)
        # Two old plane rotations meet the new column of the tridiagonal matrix, a new one clears its last entry.
        top = sin2 * beta
        bent = cos2 * beta
        middle = sin1 * alpha + cos1 * bent
        diagonal = cos1 * alpha - sin1 * bent
        size = np.hypot(diagonal, following)
        live &= size > 0
        size = np.where(size > 0, size, 1.0)
        cos, sin = diagonal / size, following / size
        w = (v - top * w2 - middle * w1) / size
        x = x + np.where(live, cos * rest, 0.0) * w
        rest = np.where(live, -sin * rest, rest)
        live &= (np.abs(rest) > goal * first) & (following > 1e-14 * np.abs(alpha))
        before, v = v, np.divide(p, following, out=np.zeros_like(p), where=following > 0)
        w1, w2, beta = w, w1, following
        cos1, cos2, sin1, sin2 = cos, cos1, sin, sin1
    return x


def jacobi_davidson(times: Callable, d: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive operator, falling, and their unit vectors.

    ``times`` multiplies a ``d x k`` block; the space and everything here is ``d`` by at most :data:`SPACE`.
    """
    wanted = min(wanted, d)
    rng = np.random.default_rng(seed)
    done, values = np.zeros((d, 0)), np.zeros(0)
    v = _orthonormal(rng.standard_normal((d, min(d, 2 * wanted))))
    w = times(v)
    probed, worst = 0, []
    for _ in range(OUTER):
        h = v.T @ w
        theta, s = np.linalg.eigh((h + h.T) / 2)
        v, w, theta = v @ s[:, ::-1], w @ s[:, ::-1], theta[::-1]
        scale = max([*values, *theta, 0.0])
        if len(values) == wanted or v.shape[1] == 0:
            larger = len(theta) and len(values) and theta[0] > values.min() + LOOSE * scale
            if larger:  # the rest of the space holds more than the last locked pair
                back = values < theta[0]
                v, w = np.hstack([done[:, back], v]), np.hstack([times(done[:, back]), w])
                done, values, probed = done[:, ~back], values[~back], 0
                continue
            if probed >= PROBES or done.shape[1] + v.shape[1] >= d:
                break
            if v.shape[1] + BLOCK > SPACE:
                v, w, theta = v[:, :KEPT], w[:, :KEPT], theta[:KEPT]
            new = w[:, -BLOCK:] if probed else rng.standard_normal((d, BLOCK))
            new = _orthonormal(new if new.size else rng.standard_normal((d, BLOCK)), done, v)
            if not new.shape[1]:
                new = _orthonormal(rng.standard_normal((d, BLOCK)), done, v)
            v, w = np.hstack([v, new]), np.hstack([w, times(new)])
            probed += 1
            continue
        k = min(wanted - len(values), v.shape[1])
        residual = w[:, :k] - v[:, :k] * theta[:k]
        residual -= done @ (done.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        worst = [*worst[-3:], size[0]]
        floor = SHARP * d * np.finfo(float).eps * scale
        stuck = len(worst) == 4 and min(worst[1:]) > worst[0] / 2 and size[0] <= LOOSE * scale
        if size[0] <= floor or stuck:
            lock = 1
            while lock < k and size[lock] <= floor:
                lock += 1
            sure = _orthonormal(v[:, :lock], done)
            done, values = np.hstack([done, sure]), np.concatenate([values, theta[: sure.shape[1]]])
            v, w, worst = v[:, lock:], w[:, lock:], []
            continue
        if v.shape[1] + k > SPACE:
            v, w, theta = v[:, :KEPT], w[:, :KEPT], theta[:KEPT]
        near = np.hstack([done, v[:, :k]])

        def project(z: np.ndarray) -> np.ndarray:
            return z - near @ (near.T @ z)

        def correction(z: np.ndarray) -> np.ndarray:
            z = project(z)
            return project(times(z) - z * theta[:k])

        t = minres(correction, project(-residual), INNER, 1e-3)
        new = _orthonormal(np.hstack([t, residual]), done, v)[:, :k] if done.shape[1] + v.shape[1] < d else t[:, :0]
        if not new.shape[1]:  # nothing new, or only rounding: a random direction goes on
            new = _orthonormal(rng.standard_normal((d, k)), done, v)[:, : d - done.shape[1] - v.shape[1]]
        if not new.shape[1]:  # the space is whole: its own pairs are exact, fresh products clear what rounding has left
            v = _orthonormal(v, done)
            w = times(v)
            worst = [*worst, *worst[-1:]]
            continue
        v, w = np.hstack([v, new]), np.hstack([w, times(new)])
    else:
        raise ArithmeticError(f"no convergence in {OUTER} rounds: residuals {worst}")
    order = np.argsort(-values, kind="stable")
    return values[order], done[:, order]


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S) ** 2``, exactly; null beyond a long."""
    rough = ((x.astype(float) * n - np.array(sums, float)) ** 2).sum(1)
    if (not len(x) or rough.max() < 2.0**61) and n * max(1, int(np.abs(x.astype(float)).max(initial=0))) < 2**62:
        return ((x * np.int64(n) - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [e if e <= _LONG.max else None for e in exact]


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row of ``df`` that takes part and each component, with :data:`ADDED`."""
    keep = [c for c in df.columns if c not in ADDED.names]
    ready = df.select(*keep, whole(df[vector]).alias(X)).where(F.col(X).isNotNull())
    sizes = ready.groupBy(F.size(X).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    top = sizes.first()
    schema = T.StructType([df.schema[c] for c in keep] + ADDED.fields)
    d = top.d if top else 0
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    ready = ready.where(F.size(X) == d)
    cov = Covariance(materialize(ready.select(X).distinct(), "whitening_fit"), d)
    trace = cov.trace()
    if not trace > 0:
        return df.sparkSession.createDataFrame([], schema)
    values, vectors = jacobi_davidson(cov.times, d, components)
    real = values > FLAT * trace
    values, vectors = values[real], vectors[:, real]
    axes = vectors / np.sqrt(values)
    error = float(np.abs(axes.T @ cov.times(axes) - np.eye(len(values))).max())
    n, sums, mean, explained = cov.n, cov.sums, cov.mean, values / trace
    k = len(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(len(keep)), d)
            whitened = (x - mean) @ axes
            each = np.repeat(np.arange(len(x)), k)
            out = [b.column(i).take(pa.array(each)) for i in range(len(keep))]
            out.append(pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))))
            out.append(pa.array(np.full(len(each), n, np.int64)))
            out.append(pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(each)))
            out.append(pa.array(whitened.ravel()))
            out.append(pa.array(np.tile(explained, len(x))))
            out.append(pa.array(np.full(len(each), error)))
            yield pa.record_batch(out, names=[*keep, *ADDED.names])

    return ready.mapInArrow(score, schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(rows).drop("embedding")
