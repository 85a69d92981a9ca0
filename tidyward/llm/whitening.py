"""Whitening of vectors by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. A product with a block of vectors is one Spark pass over the
fit list, which centres each vector before multiplying and returns one small matrix.
Ritz pairs of a growing subspace that have a residual at the limit of double precision
are locked; for the others a correction equation, projected on what is orthogonal to
locked and current vectors, is solved by a few steps of MINRES, all pairs in step, and
the corrections widen the subspace. So all pairs of a round share their passes.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import store

SHIFT, SCALE, EDGE = 1_000_000, 64, float(1 << 40)
EPS = np.finfo(np.float64).eps
Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, b: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Approximate solutions of one symmetric system per column of ``b``, all in step.

    Ends after ``steps`` products, or once each residual is at most ``goal`` of its start.
    """
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    first = np.linalg.norm(b, axis=0)
    live = first > 0
    v = b / np.where(live, first, 1)
    rest, beta = first.copy(), np.zeros_like(first)
    c_old, c = np.ones_like(first), np.ones_like(first)
    s_old, s = np.zeros_like(first), np.zeros_like(first)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        new = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        one = np.hypot(delta, new)
        live &= one > 0
        one = np.where(live, one, 1)
        two, three = s * alpha + c_old * c * beta, s_old * beta
        c_old, c, s_old, s = c, delta / one, s, new / one
        w_old, w = w, np.where(live, (v - three * w_old - two * w) / one, 0)
        x += np.where(live, c * rest, 0) * w
        rest = -s * rest
        live &= new > EPS * (np.abs(alpha) + beta)      # else the Krylov space is exhausted
        v_old, v = v, np.where(live, p / np.where(live, new, 1), 0)
        beta = np.where(live, new, 0)
        if not (live & (np.abs(rest) > goal * first)).any():
            break
    return x


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal columns of ``against``."""
    for _ in range(2):
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        for q in against:
            new = new - q @ (q.T @ new)
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8]
    return new


def jacobi_davidson(product: Product, width: int, k: int, steps: int = 4, guards: int = 4,
                    most: int = 500, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and eigenvectors of a positive semidefinite matrix.

    ``product`` multiplies it with the columns of a block. Raises if residuals haven't
    reached 4 sqrt(width) roundings of the largest eigenvalue after ``most`` rounds.
    """
    r = np.random.default_rng(seed)
    block = min(width, k + guards)
    limit = min(width, 6 * block)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    basis = np.linalg.qr(r.normal(size=(width, block)))[0]
    image = product(basis)
    for _ in range(most):
        h = basis.T @ image
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        wanted = k - len(values)
        rest = image - basis * theta
        scale = max([theta[0], *values[:1]])
        done = np.linalg.norm(rest, axis=0) <= 4 * np.sqrt(width) * EPS * scale
        lead = int(np.argmin(np.append(done[:wanted], False)))
        locked, values = np.hstack([locked, basis[:, :lead]]), np.append(values, theta[:lead])
        basis, image, theta, rest, done = basis[:, lead:], image[:, lead:], theta[lead:], rest[:, lead:], done[lead:]
        wanted -= lead
        if not wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if limit < width and basis.shape[1] > limit - block:
            # a restart goes on with the best pairs; their images are computed anew
            keep = 2 * block
            basis = orthonormal(basis[:, :keep], locked)
            image = product(basis)
            rest = image - basis * (basis * image).sum(0)
            theta, done = (basis * image).sum(0), done[:basis.shape[1]]
        near = min(wanted + guards, basis.shape[1])
        open_ = np.flatnonzero(~done[:near])
        q = np.hstack([locked, basis[:, :near]])
        shift = theta[open_]

        def project(t):
            return t - q @ (q.T @ t)

        def corrected(t):
            t = project(t)
            return project(product(t) - t * shift)

        new = orthonormal(minres(corrected, -project(rest[:, open_]), steps, 1e-3), locked, basis)
        missing = width - locked.shape[1] - basis.shape[1]
        if not new.shape[1] and missing:
            new = orthonormal(r.normal(size=(width, min(block, missing))), locked, basis)
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
        else:       # the whole space is searched: only roundings are left to remove
            basis = orthonormal(basis, locked)
            image = product(basis)
    raise ArithmeticError(f"{k - len(values)} eigenpairs have not converged")


def whiten(vectors: DataFrame, k: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining input row and component: id, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries go, as do those of another
    length than the commonest (of equally common ones the longest). An entry c becomes
    floor(64 c) + 1,000,000; entries beyond 2**34 count as 2**34, to either side. Each distinct
    vector of these integers is once in the fit list of n vectors. Components are the
    unit eigenvectors of its covariance (divisor n), numbered by falling eigenvalue; there are
    min(k, width, rank), where eigenvalues of less than 1e-12 of the largest count as none.
    deviation is exact (null beyond 64 bits). identity_error is measured on the whitened fit list. Rows
    of equal or null ids are rows of their own; other columns are ignored. An empty table, or one
    of a single distinct vector, gives no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(
        F.forall("vec", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
        & (F.size("vec") > 0))
    lengths = given.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), F.desc("n")).first()
    width = lengths["n"] if lengths else 0
    rows = store(given.filter(F.size("vec") == width).select("id", F.transform("vec", lambda c: F.floor(
        F.greatest(F.least(c.cast("double") * SCALE, F.lit(EDGE)), F.lit(-EDGE))) + SHIFT).alias("x")))
    fit = store(rows.select("x").distinct())
    n, sums = _sums(fit)
    # x - S/n = (x - whole) - part, both exact or correctly rounded
    whole = np.array([s // n for s in sums], np.int64) if n else np.zeros(0, np.int64)
    left = [s % n for s in sums] if n else []
    part = np.array([float(v) / n for v in left])
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")

    def centred(batch):
        return (matrix(batch.column("x"), width) - whole) - part

    trace = _total(fit, centred, lambda c: (c * c).sum(keepdims=True), (1, 1))[0, 0] / max(n, 1)
    if not trace > 0:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def product(block):
        return _total(fit, centred, lambda c: c.T @ (c @ block), (width, block.shape[1])) / n

    values, axes = jacobi_davidson(product, width, min(k, width))
    real = values > 1e-12 * values[0]
    values, axes = values[real], axes[:, real]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(values))] < 0, -1, 1)
    scaled = axes / np.sqrt(values)
    count = len(values)
    gram = _total(fit, centred, lambda c: (c @ scaled).T @ (c @ scaled), (count, count)) / n
    error = float(np.abs(gram - np.eye(count)).max())
    explained = values / trace

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                m = some.num_rows
                moved = (centred(some) @ axes) / np.sqrt(values)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(np.repeat(np.arange(m), count))),
                     pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n)),
                     pa.array(deviations(matrix(some.column("x"), width) - whole, n, left), pa.int64()).take(
                         pa.array(np.repeat(np.arange(m), count))),
                     pa.array(moved.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def deviations(d: np.ndarray, n: int, left: list[int]) -> list:
    """Sums over columns of (n d - left) squared, exactly; None beyond 64 bits."""
    high = n * (int(np.abs(d).max(initial=0)) + 1)
    if high * high * max(d.shape[1], 1) < 1 << 63:
        return ((d * n - np.array(left, np.int64)) ** 2).sum(1).tolist()
    sums = ((d.astype(object) * n - np.array(left, object)) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The count of vectors and the exact sum of each of their entries."""
    def add(batches):
        for batch in batches:
            x = batch.column("x")
            if len(x):
                total = np.append(matrix(x, len(x[0])).sum(0), len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)],
                                                 ["slot", "part"])

    got = fit.mapInArrow(add, "slot bigint, part bigint").groupBy("slot").agg(
        F.sum(F.col("part").cast("decimal(20,0)")).alias("total")).orderBy("slot").collect()
    totals = [int(r["total"]) for r in got]
    return (totals[-1], totals[:-1]) if totals else (0, [])


def _total(fit: DataFrame, centred, of, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``of`` (a matrix of ``shape``) over batches of centred vectors.

    Each task adds its batches and returns one matrix; Spark adds those entry by entry, so the
    driver gets one matrix whatever the table holds.
    """
    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(centred(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())],
                                         ["slot", "part"])

    out = np.zeros(shape[0] * shape[1])
    for r in fit.mapInArrow(add, "slot bigint, part double").groupBy("slot").agg(F.sum("part").alias("total")).collect():
        out[r["slot"]] = r["total"]
    return out.reshape(shape)
