"""Operator 11, embedding whitening by a block Jacobi-Davidson method that never forms the covariance.

Entries become integers on a grid, so the fit list (distinct vectors), its count and its sums are exact.
The list is a written table of packed blocks; the driver only holds vectors of one dimension's length: a
search space, what it spans and the eigenvectors locked so far. A product with the covariance is a job:
each task centres its blocks, multiplies them twice and returns one d x b part, and the parts are added
up by Spark. Rayleigh-Ritz on the search space gives approximate eigenpairs. Leading ones whose residual
is at the level of double precision are locked; for the others the correction equation, projected off the
approximations, is solved by MINRES, all of them in step so that each inner step is one product. The
space grows by the corrections and restarts from its best vectors. At the end the whitened list's own
covariance is measured against the identity in one more pass.

Edge cases: rows whose vector is null or empty or has null, non-finite or ungriddable (beyond 2^53)
entries are left out, as are those of another length than the most frequent (the smaller of two); repeated
rows count once in the fit and are all returned; components without variance (fewer vectors than
components, constant dimensions) are not returned; a deviation beyond a long is null; an empty table gives
an empty result; ids may be null or repeated; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

COMPONENTS = 16
#: Steps of the grid in one unit, and its offset.
GRID, OFFSET = 64, 1_000_000
#: Bytes of a packed block of vectors.
BLOCK_BYTES = 4 << 20
#: Vectors tried beyond those wanted, inner steps for each correction, search space as a multiple of those wanted.
SPARE, INNER, SPACE = 4, 6, 5
EPS = np.finfo(np.float64).eps
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n times x less the sums, exact: as long where that fits, else as Python integers."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(off: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exact; None beyond a long."""
    if off.dtype != object and len(off) and off.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < 1 << 62:
        return (off * off).sum(axis=1).tolist()
    return [s if (s := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in off]


class FitList:
    """The distinct vectors as packed blocks, their number, sums per dimension and products with their covariance."""

    def __init__(self, rows: DataFrame, d: int):
        def packed(batches):
            size = max(1, BLOCK_BYTES // (8 * d))
            for batch in batches:
                x = np.ascontiguousarray(matrix(batch.column(0), d))
                for k in range(0, len(x), size):
                    yield pa.RecordBatch.from_arrays([pa.array([x[k : k + size].tobytes()], pa.binary())], ["block"])

        self.d = d
        self.blocks = written(rows.select("x").distinct().mapInArrow(packed, "block binary"))
        columns = self.blocks.mapInArrow(self._per_block(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), pa.int64()), "k int, v long")
        total = {r.k: int(r.v) for r in columns.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
        self.n, self.sums = total[0], [total[k + 1] for k in range(d)]
        self.trace = float(self._summed(lambda c: (c * c).sum(keepdims=True).ravel(), 1)[0]) / self.n

    def _per_block(self, part, kind: pa.DataType):
        """A function of batches that yields (k, v) of part(vectors), added up over the task for doubles."""
        d = self.d

        def run(batches):
            for batch in batches:
                for block in batch.column(0):
                    out = part(np.frombuffer(block.as_py(), np.int64).reshape(-1, d))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out, kind)], ["k", "v"])

        return run

    def _summed(self, part, size: int) -> np.ndarray:
        """The sum over all vectors of part(centred vectors), a flat array of a size that the rows do not change."""
        d, n, sums = self.d, self.n, self.sums

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for block in batch.column(0):
                    x = np.frombuffer(block.as_py(), np.int64).reshape(-1, d)
                    total += part(offsets(x, n, sums).astype(np.float64) / n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["k", "v"])

        out = np.zeros(size)
        for r in self.blocks.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out

    def product(self, w: np.ndarray) -> np.ndarray:
        """The covariance times w (d x b), in one pass over the list."""
        return self._summed(lambda c: (c.T @ (c @ w)).ravel(), w.size).reshape(w.shape) / self.n

    def identity_error(self, q: np.ndarray, e: np.ndarray) -> float:
        """The largest entry of the whitened list's covariance less the identity."""
        k, scaled = len(e), q / np.sqrt(e)

        def part(c):
            z = c @ scaled
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        total = self._summed(part, k + k * k) / self.n
        mean = total[:k]
        return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of t add to the given bases; columns that add nothing go."""
    size = np.linalg.norm(t, axis=0)
    t = t[:, size > 0] / size[size > 0]
    for _ in range(3):  # what is small after a projection is no longer orthogonal to the last digit
        for basis in against:
            t = t - basis @ (basis.T @ t)
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-9]
    return t


def minres(apply, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of apply(x) = b, column by column, in steps of one application to all columns."""
    dot = lambda p, q: np.einsum("ij,ij->j", p, q)
    over = lambda p, q: np.where(q > 0, p / np.where(q > 0, q, 1), 0)
    x, r, goal = np.zeros_like(b), b.copy(), tolerance * np.linalg.norm(b, axis=0)
    p, s = [b], [apply(b)]
    for k in range(steps):
        a = over(dot(r, s[0]), dot(s[0], s[0]))
        x, r = x + a * p[0], r - a * s[0]
        if k == steps - 1 or (np.linalg.norm(r, axis=0) <= goal).all():
            break
        next_p, next_s = s[0], apply(s[0])
        for old_p, old_s in zip(p, s, strict=True):  # against the last two directions
            c = over(dot(next_s, old_s), dot(old_s, old_s))
            next_p, next_s = next_p - c * old_p, next_s - c * old_s
        p, s = [next_p, p[0]], [next_s, s[0]]
    return x


def leading_pairs(product, d: int, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(e, q): the k largest eigenvalues, falling, and unit eigenvectors of a symmetric positive operator on d entries."""
    start = np.random.default_rng(seed).standard_normal((d, min(d, k + SPARE)))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = orthonormal(start)
    spanned = product(space)
    worst: list[float] = []
    while True:
        h = space.T @ spanned
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        want = k - locked.shape[1]
        u, au = space @ y, spanned @ y
        left = au[:, :want] - u[:, :want] * theta[:want]
        left -= locked @ (locked.T @ left)
        size = np.linalg.norm(left, axis=0)
        top = max([abs(theta[0]), *values[:1]])
        good = size <= 16 * EPS * np.sqrt(d) * top
        whole = u.shape[1] + locked.shape[1] >= d
        worst.append(float(size.max()))
        # Where the space is whole, or nothing has been gained for long, what is left is the rounding of the products.
        settled = whole or (len(worst) > 8 and min(worst[-4:]) > 0.5 * min(worst[:-4]) and worst[-1] <= 1e-11 * top)
        n = want if settled or good.all() else int(np.argmin(good))
        locked, values = np.concatenate([locked, u[:, :n]], axis=1), np.concatenate([values, theta[:n]])
        if n == want:
            break
        u, au, theta, left = u[:, n:], au[:, n:], theta[n:], left[:, n:]
        best = np.concatenate([locked, u[:, : want - n]], axis=1)
        off = lambda t: t - best @ (best.T @ t)  # noqa: B023, E731
        shift = theta[: want - n]
        t = minres(lambda v: off(product(off(v)) - shift * off(v)), -off(left), INNER, 0.5 ** min(len(worst), 20))  # noqa: B023
        if u.shape[1] + t.shape[1] > SPACE * k:
            u, au = u[:, : 2 * k], au[:, : 2 * k]
        t = orthonormal(t, locked, u)
        t = t if t.shape[1] else orthonormal(np.random.default_rng(len(worst)).standard_normal((d, want)), locked, u)
        space, spanned = np.concatenate([u, t], axis=1), np.concatenate([au, product(t)], axis=1)
    # Once more among themselves: pairs locked apart may be as good as equal.
    q = np.linalg.qr(locked)[0]
    h = q.T @ product(q)
    e, y = np.linalg.eigh((h + h.T) / 2)
    q = q @ y[:, ::-1]
    return e[::-1], q * np.where(q[np.abs(q).argmax(axis=0), np.arange(k)] < 0, -1, 1)


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound vector and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * GRID >= 2.0**53)
    rows = rows.filter((F.size("v") > 0) & ~F.exists("v", bad))
    rows = written(rows.select("vec_id", F.transform("v", lambda c: (F.floor(c * GRID) + OFFSET).cast("long")).alias("x")))
    sizes = sorted((-r.m, r.d) for r in rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).collect())
    if not sizes:
        return spark.createDataFrame([], RESULT)
    d = sizes[0][1]
    rows = rows.filter(F.size("x") == d)
    fit = FitList(rows, d)
    e, q = leading_pairs(fit.product, d, min(components, d))
    some = e > d * EPS * max(fit.trace, 0)
    e, q = e[some], q[:, some]
    if not len(e):
        return spark.createDataFrame([], RESULT)
    error, n, sums, trace = fit.identity_error(q, e), fit.n, fit.sums, fit.trace
    scaled, share, k = q / np.sqrt(e), e / trace, len(e)

    def project(batches):
        for batch in batches:
            off = offsets(matrix(batch.column(1), d), n, sums)
            z = (off.astype(np.float64) / n) @ scaled
            m = len(z)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(deviations(off), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, RESULT)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
