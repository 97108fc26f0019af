"""Whitening of vectors along their leading components, found by Jacobi-Davidson.

Entries c become whole numbers floor(256 c).  The fit list is each different vector once;
its size n and the sums S of every dimension are exact.  The covariance V of the fit list
is never formed: one job multiplies it with a few columns at a time,

    V B = 1/n sum over x of (x - S/n) ((x - S/n)' B),

each task adding up its rows, so that what is shuffled and returned is one small matrix.

Jacobi-Davidson on the driver holds a search space of some dozen columns of a vector's
length.  Each round takes Ritz pairs of the search space (Rayleigh-Ritz), locks leading
pairs whose residual has reached double precision, and extends the space by corrections
t of all other wanted pairs (u, e) at once:

    (I - QQ') (V - e I) (I - QQ') t = -(V u - e u),   Q: locked and wanted vectors,

solved by some steps of MINRES side by side, so that a step is one job for all pairs.

Defined results: rows without a vector, or whose vector is empty or holds null or
non-finite entries, are left out; so are vectors of another length than the most frequent
one (the longest of those that tie).  Repeated rows each get their rows, but count once in
the fit list.  Components whose eigenvalue is zero to double precision do not exist, so
fewer than wanted are returned where the fit list has no further direction, and none for
an empty table or one different vector.  Components of equal eigenvalues may be turned
within their plane.  ``deviation`` is null where the exact number exceeds a long.  Further
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

COMPONENTS = 4
SCALE = 256
#: Residuals, relative to the largest eigenvalue, that count as double precision.
PRECISION = 2.0**-47
#: Columns of the search space beyond the wanted ones: at its start, kept at a restart, at most.
START, KEPT, SPACE = 4, 6, 28
#: Steps of MINRES for one correction, and rounds, at most; both end earlier by themselves.
INNER, ROUNDS = 8, 200

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---- the whole numbers -----------------------------------------------------------------
def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole numbers of the vectors that can be used."""
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    usable = (F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = stored(given.where(usable).select("vec_id", F.transform("e", lambda c: F.floor(c * scale)).alias("x")), "whole")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == sizes["size"]) if sizes else rows


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


# ---- sums over all rows ------------------------------------------------------------------
def total(rows: DataFrame, value: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``value`` over batches of x, an array of doubles of the given shape."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                out += value(_matrix(batch.column(0)))
        flat = out.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["place", "value"])

    out = np.zeros(int(np.prod(shape)))
    for place, amount in rows.select("x").mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value")).collect():
        out[place] = amount
    return out.reshape(shape)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and each dimension's exact sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                safe = float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62
                part = (x if safe else x.astype(object)).sum(axis=0).tolist()
                out = part if out is None else [a + b for a, b in zip(out, part, strict=True)]
                n += len(x)
        if out is not None:
            places = pa.array(range(-1, len(out)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array([str(v) for v in [n, *out]])], ["place", "amount"])

    parts = rows.select("x").mapInArrow(add, "place int, amount string")
    found = parts.groupBy("place").agg(F.sum(F.col("amount").cast("decimal(38,0)"))).orderBy("place").collect()
    return (int(found[0][1]), [int(r[1]) for r in found[1:]]) if found else (0, [])


# ---- Jacobi-Davidson -----------------------------------------------------------------------
def _orthonormal(columns: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to the others; what adds nothing is dropped."""
    out = np.empty((len(columns), 0))
    for column in columns.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            for basis in (*others, out):
                column = column - basis @ (basis.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10:
            column /= left
            for basis in (*others, out):
                column = column - basis @ (basis.T @ column)
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, aim: float) -> np.ndarray:
    """Solutions of symmetric systems, one a column, by MINRES side by side.

    Ends after ``steps`` products or once all residuals have shrunk by ``aim``.  A
    column whose space is used up keeps its solution.
    """
    beta = np.linalg.norm(right, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    x, w, w2 = (np.zeros_like(right) for _ in range(3))
    r1, r2, y = right.copy(), right.copy(), right.copy()
    old_beta, dbar, epsilon, phibar = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    cs, sn, going = -np.ones_like(beta), np.zeros_like(beta), beta > 0
    for step in range(steps):
        v = y / np.where(going, beta, 1.0)
        y = product(v)
        if step:
            y = y - r1 * (beta / np.where(old_beta > 0, old_beta, 1.0))
        alpha = (v * y).sum(axis=0)
        y = y - r2 * (alpha / np.where(going, beta, 1.0))
        r1, r2, old_beta = r2, y, beta
        beta = np.linalg.norm(y, axis=0)
        old_epsilon, delta = epsilon, cs * dbar + sn * alpha
        gbar, epsilon, dbar = sn * dbar - cs * alpha, sn * beta, -cs * beta
        gamma = np.hypot(gbar, beta)
        solvable = going & (gamma > 0)
        gamma = np.where(gamma > 0, gamma, 1.0)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - w1 * old_epsilon - w2 * delta) / gamma
        x = x + np.where(solvable, phi, 0.0) * np.where(solvable, w, 0.0)
        going = solvable & (beta > 1e-14 * first) & (np.abs(phibar) > aim * first)
        if not going.any():
            break
        for columns in (y, r1, r2, w, w2):
            columns[:, ~going] = 0.0
    return x


@dataclass
class Pairs:
    """Eigenvalues, falling, their unit vectors as columns, and the norms of their residuals."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int = 0


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 12) -> Pairs:
    """Leading eigenpairs of a symmetric positive semidefinite matrix given by its products."""
    calls = [0]

    def times(columns: np.ndarray) -> np.ndarray:
        calls[0] += 1
        return product(columns)

    wanted = min(wanted, size)
    locked, values, residuals = np.empty((size, 0)), [], []
    space = _orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, wanted + START))))
    image = times(space)
    best, stalled = np.inf, 0
    for round_ in range(ROUNDS):
        small = space.T @ image
        found, turn = np.linalg.eigh((small + small.T) / 2)
        found, turn = found[::-1], turn[:, ::-1]
        ritz, mapped = space @ turn, image @ turn
        left = min(wanted - len(values), ritz.shape[1])
        rest = mapped[:, :left] - ritz[:, :left] * found[:left]
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        top = max([*values, *found[:1], 0.0])
        # at rounding level a residual no longer falls
        stalled = 0 if norms.max(initial=0.0) < 0.5 * best else stalled + 1
        best = min(best, norms.max(initial=0.0))
        good = norms <= top * (PRECISION if stalled < 4 else PRECISION * 64)
        whole = len(values) + space.shape[1] >= size
        ready = left if whole or top <= 0 or round_ == ROUNDS - 1 else int(np.argmin([*good, False]))
        if ready:
            locked = np.column_stack([locked, _orthonormal(ritz[:, :ready], locked)])
            values += found[:ready].tolist()
            residuals += norms[:ready].tolist()
            best, stalled = np.inf, 0
        if len(values) >= wanted or whole:
            break
        space, image = ritz[:, ready:], mapped[:, ready:]
        found, rest, norms, good = found[ready:], rest[:, ready:], norms[ready:], good[ready:]
        left -= ready
        if space.shape[1] > SPACE:
            space, image, found = space[:, : left + KEPT], image[:, : left + KEPT], found[: left + KEPT]
        if not left:  # all pairs of the space are locked: go on with any direction
            new = _orthonormal(np.random.default_rng(seed + len(values)).standard_normal((size, START)), locked)
        else:
            open_ = ~good
            about = np.column_stack([locked, space[:, :left]])
            shift = found[:left][open_]

            def projected(columns: np.ndarray) -> np.ndarray:
                columns = columns - about @ (about.T @ columns)
                columns = times(columns) - columns * shift
                return columns - about @ (about.T @ columns)

            # far from the goal, corrections needn't be solved well
            steps = INNER if (norms[open_] < 0.05 * top).all() else 2
            solved = minres(projected, -rest[:, open_], steps, 1e-3)
            new = _orthonormal(np.column_stack([solved, rest[:, open_]]) if round_ < 2 else solved, locked, space)
            if not new.shape[1]:
                new = _orthonormal(np.random.default_rng(seed + round_).standard_normal((size, 1)), locked, space)
        if not new.shape[1]:
            continue
        space, image = np.column_stack([space, new]), np.column_stack([image, times(new)])
    order = np.argsort(-np.array(values), kind="stable")
    return Pairs(np.array(values)[order], locked[:, order], np.array(residuals)[order], calls[0])


# ---- whitening -----------------------------------------------------------------------------
@dataclass
class Whitening:
    """What the fit list says: its size, exact sums, trace of V, pairs, and the check of whitened covariance."""

    n: int
    sums: list[int]
    trace: float
    pairs: Pairs
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits components to the different vectors among ``rows`` (x); None if there are none."""
    different = stored(rows.select("x").distinct(), "fit")
    n, sums_ = sums(different)
    if not n:
        return None
    mean, size = np.array([s / n for s in sums_]), len(sums_)
    trace = float(total(different, lambda x: ((x - mean) ** 2).sum(keepdims=True)[0], (1,))[0]) / n

    def product(columns: np.ndarray) -> np.ndarray:
        def value(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ columns)

        return total(different, value, columns.shape) / n

    pairs = jacobi_davidson(product, size, components)
    real = pairs.values > 64 * size * np.finfo(float).eps * max(trace, 0.0)
    pairs = Pairs(pairs.values[real], pairs.vectors[:, real], pairs.residuals[real], pairs.products)
    error = 0.0
    if real.any():
        turn = pairs.vectors / np.sqrt(pairs.values)

        def value(x: np.ndarray) -> np.ndarray:
            white = (x - mean) @ turn
            return white.T @ white

        error = float(np.abs(total(different, value, (turn.shape[1],) * 2) / n - np.eye(turn.shape[1])).max())
    return Whitening(n, sums_, trace, pairs, error)


def _deviations(x: np.ndarray, n: int, sums_: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2; None beyond a long."""
    most = n * float(np.abs(x.astype(float)).max()) + max(abs(s) for s in sums_)
    if most * most * x.shape[1] < 2.0**62:
        return ((n * x - np.array(sums_, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums_, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, as in ``SCHEMA``."""
    rows = quantized(vectors)
    fitted = fit(rows, components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    mean, n, sums_ = fitted.mean, fitted.n, fitted.sums
    turn = fitted.pairs.vectors / np.sqrt(fitted.pairs.values)
    explained, error, k = fitted.pairs.values / fitted.trace if fitted.trace else fitted.pairs.values, fitted.identity_error, turn.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1))
            deviation = pa.array(_deviations(x, n, sums_), pa.int64())
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                deviation.take(each),
                pa.array(((x - mean) @ turn).reshape(-1)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, SCHEMA)
