"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson over distributed products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .topk import fixed_point

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows that are multiplied at once in a task; Ritz vectors beyond the wanted ones; MINRES steps of a correction equation at
#: first and at most; basis vectors before a restart; rounds at most;
#: rows of sums that come to the driver.
ROWS, GUARD, INNER, BASIS, ROUNDS, MERGED = 4096, 8, (8, 64), 192, 60, 16


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of integer lists of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), width)


def summed(fit: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of ``make`` over blocks of the rows of ``fit``, flat.

    A task adds up its own blocks to one row; MERGED groups of tasks are added up by further tasks, and the driver adds
    the MERGED rows that are left.
    """

    def run(batches):
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                one = make(matrix(batch["x"].slice(start, ROWS), width)).ravel()
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % MERGED], pa.int32()), pa.array([total])], ["part", "sums"])

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"part": rows["part"].slice(0, 1), "sums": pa.array([matrix(rows["sums"].combine_chunks(), len(rows["sums"][0])).sum(axis=0)])})

    schema = f"part int, sums array<{kind}>"
    found = fit.mapInArrow(run, schema).groupBy("part").applyInArrow(merge, schema).toArrow()["sums"].combine_chunks()
    return matrix(found, len(found[0])).sum(axis=0)


def minres(product, right: np.ndarray, shifts: np.ndarray, steps: int, within: float) -> np.ndarray:
    """Approximate x with product(x) - shifts * x = right, a column for each shift; product is symmetric.

    Lanczos vectors of all columns are multiplied together, so a step is one product; a column is left as it is when its
    space is exhausted.
    """
    scale = np.linalg.norm(right, axis=0)
    tiny = np.finfo(float).tiny
    x = np.zeros_like(right)
    old, now = np.zeros_like(right), right / np.maximum(scale, tiny)
    before, last = np.zeros_like(right), np.zeros_like(right)  # directions
    beta, phi = np.zeros(len(shifts)), scale.copy()
    c_old, s_old, c, s = np.ones(len(shifts)), np.zeros(len(shifts)), np.ones(len(shifts)), np.zeros(len(shifts))
    live = scale > 0
    for _ in range(steps):
        if not live.any():
            break
        next_ = product(now) - shifts * now - beta * old
        alpha = (now * next_).sum(axis=0)
        next_ -= alpha * now
        above = np.linalg.norm(next_, axis=0)
        # the new column of the tridiagonal matrix under the two rotations before it, and its own rotation
        far, middle = s_old * beta, c_old * beta
        near, diagonal = c * middle + s * alpha, c * alpha - s * middle
        size = np.hypot(diagonal, above)
        live &= size > scale * 1e-15
        safe = np.where(size > 0, size, 1)
        c_old, s_old, c, s = c, s, diagonal / safe, above / safe
        direction = (now - near * last - far * before) / safe
        x += np.where(live, c * phi * direction, 0)
        phi = -s * phi
        before, last = last, direction
        live &= (above > 1e-14 * np.abs(alpha).max(initial=tiny)) & (np.abs(phi) > within * scale)
        old, now, beta = now, next_ / np.where(above > 0, above, 1), above
    return x


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the bases; what adds nothing is left out."""
    kept: list[np.ndarray] = []
    for column in (new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)).T:
        for _ in range(3):
            for basis in (*bases, *([np.stack(kept, axis=1)] if kept else [])):
                column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept.append(column)
    return np.stack(kept, axis=1) if kept else np.zeros((len(new), 0))


def jacobi_davidson(product, d: int, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric d x d operator, falling, and unit eigenvectors; all d if k is more.

    product multiplies a d x b matrix. Each round: Rayleigh-Ritz in the subspace; leading pairs whose residual is at double
    precision are locked, in order; for the next ones the correction equations, projected against what is locked and the
    Ritz vectors, are solved roughly by MINRES, all in the same products; the corrections widen the subspace. It
    starts anew from its best vectors when it has BASIS columns. Raises ArithmeticError if ROUNDS do not do.
    """
    k = min(k, d)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = orthonormal(np.random.default_rng(seed).normal(size=(d, min(d, k + GUARD))))
    image, precision = product(basis), np.finfo(float).eps * max(d, 64)
    for round_ in range(ROUNDS):
        small = basis.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        turn, ritz = turn[:, ::-1], ritz[::-1]
        basis, image = basis @ turn, image @ turn
        residual = image - basis * ritz
        residual -= locked @ (locked.T @ residual)
        top = max(values.max(initial=0), np.abs(ritz).max(initial=0))
        whole = locked.shape[1] + basis.shape[1] == d  # nothing is left to add: what remains is rounding
        good = np.linalg.norm(residual, axis=0) <= precision * top * (100 if whole else 1)
        n = int(np.argmin(np.append(good, False)))
        locked, values = np.concatenate([locked, basis[:, :n]], axis=1), np.append(values, ritz[:n])
        basis, image, ritz, residual = basis[:, n:], image[:, n:], ritz[n:], residual[:, n:]
        if len(values) >= k:
            break
        active = min(k - len(values) + GUARD, basis.shape[1])
        if basis.shape[1] + active > BASIS:
            basis, image = basis[:, : 2 * active], image[:, : 2 * active]
        out = np.concatenate([locked, basis[:, :active]], axis=1)
        project = lambda m: m - out @ (out.T @ m)  # noqa: B023, E731
        step = minres(lambda m: project(product(project(m))), -project(residual[:, :active]), ritz[:active], min(INNER[0] + 4 * round_, INNER[1]), 0.5 ** (round_ + 2))
        new = orthonormal(step, locked, basis)
        if not new.shape[1] and not whole:  # a subspace that holds no more of the operator: go on in another direction
            new = orthonormal(np.random.default_rng(seed + round_ + 1).normal(size=(d, 1)), locked, basis)
        if new.shape[1]:
            basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
        else:
            image = product(basis)
    else:
        raise ArithmeticError(f"{len(values)} of {k} eigenpairs after {ROUNDS} rounds")
    small = locked.T @ product(locked)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:k], (locked @ turn)[:, ::-1][:, :k]


class Whitening:
    """Means and leading components of a fit list: n, sums (integers), values, vectors, trace, identity_error."""

    def __init__(self, fit: DataFrame, width: int, k: int):
        """fit has one column ``x`` (array<long> of ``width``), each vector once; it is read once for each product."""
        self.n = n = fit.count()
        self.width = width
        self.sums = sums = summed(fit, width, lambda x: x.sum(axis=0), "long") if n and width else np.zeros(width, np.int64)
        centred = lambda x: (n * x - sums) / n

        def product(q: np.ndarray) -> np.ndarray:
            def make(x):
                c = centred(x)
                return c.T @ (c @ q)

            return summed(fit, width, make).reshape(q.shape) / n

        self.trace = float(summed(fit, width, lambda x: (centred(x) ** 2).sum(axis=0)).sum() / n) if n and width else 0.0
        self.values, self.vectors, self.identity_error = np.zeros(0), np.zeros((width, 0)), 0.0
        if self.trace > 0:
            values, vectors = jacobi_davidson(product, width, k)
            some = values > values[0] * np.finfo(float).eps * max(width, 64)
            vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
            self.values, self.vectors = values[some], vectors[:, some]
            k = len(self.values)

            def moments(x):
                w = self.apply(x)
                return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

            found = summed(fit, width, moments) / n
            covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
            self.identity_error = float(np.abs(covariance - np.eye(k)).max())

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((self.n * x - self.sums) / self.n) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        off = self.n * x - self.sums
        if off.size and (off.astype(np.float64) ** 2).sum(axis=1).max() > 9.2e18:
            raise OverflowError("a deviation does not fit a long")
        return (off * off).sum(axis=1)


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (1 to k), n, deviation, whitened, explained, identity_error of every row with a finite vector.

    Entries become x = floor(64 c) + 1000000; the covariance is over each distinct x once. Products with it are passes over
    the fit list, never a d x d matrix; on the driver are matrices of d rows and BASIS columns at most. Rows whose vector
    is null or holds null or non-finite entries are left out. Shorter vectors count as padded by zeros. Directions without
    variance are no components, so fewer than k may be returned, and none if all vectors are equal. Rows that repeat an id,
    or have none, are each returned; an empty table gives an empty result; other columns are ignored. A deviation beyond
    64 bits is an error.
    """
    rows = vectors.select("vec_id", F.transform(fixed_point(F.col("embedding"), SCALE), lambda x: x + OFFSET).alias("x")).where("x is not null")
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x"))))
    fit = cut(rows.select("x").distinct()).persist()  # passes read memory, and the checkpoint where an executor was lost
    of = Whitening(fit, width, k)
    fit.unpersist()
    share = of.values / of.trace if of.trace else of.values

    def run(batches):
        n = len(of.values)
        for batch in batches:
            for start in range(0, batch.num_rows if n else 0, ROWS):
                part = batch.slice(start, ROWS)
                x = matrix(part["x"], of.width)
                at, m = pa.array(np.repeat(np.arange(len(x)), n)), len(x)
                columns = [part["vec_id"].take(at), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), m)), pa.array(np.full(m * n, of.n)), pa.array(np.repeat(of.deviation(x), n)), pa.array(of.apply(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * n, of.identity_error))]
                yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
