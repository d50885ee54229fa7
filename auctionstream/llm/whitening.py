"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed covariance products.

The driver holds a block of directions, never a vector of the table. Each product of the covariance with the block is
one pass of the tasks over the distinct vectors; a task centres its vectors, multiplies, and returns one block.
A polynomial in the covariance, built from such passes, damps the part of the spectrum that isn't wanted; QR and
Rayleigh-Ritz follow, until the residuals of the wanted directions certify them.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auctionstream.session import stage

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
#: Passes of one polynomial. The damping of a round grows with its power; rounding limits what one round may gain.
DEGREE = 12
#: A direction is certified when the covariance moves it off itself by no more than this share of the largest eigenvalue.
RESIDUAL = 2e-15
#: Good enough if rounding stops the residuals from falling further.
LAST_RESIDUAL = 1e-12
MOST_ROUNDS = 200
#: Directions with less of the total variance than this are rounding.
LEAST_SHARE = 1e-13
_LARGEST = 4.0e18
_LOW_BITS = 32


@dataclass(frozen=True)
class Model:
    """n distinct vectors with sums ``sums`` per dimension; unit ``components`` in columns, falling ``eigenvalues``."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    rounds: int
    residual: float


def on_lattice(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is whole, with ``x``: every entry c as floor(64 c) + 1,000,000.

    A null vector, and one with a null, infinite or undefined entry, goes. So do vectors of another length than the
    most frequent one (of several, the longest), since they lie in another space.
    """
    v = F.col(f"`{vector}`")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(v.isNotNull() & whole)
    lengths = kept.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    if not lengths:
        return kept.withColumn("x", F.array().cast("array<bigint>"))

    def cell(c: Column) -> Column:
        scaled = F.lit(SCALE) * c.cast("double")
        return F.floor(F.least(F.greatest(scaled, F.lit(-_LARGEST)), F.lit(_LARGEST))) + F.lit(SHIFT).cast("bigint")

    return kept.where(F.size(v) == lengths[0].d).withColumn("x", F.transform(v, cell))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _totals(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of ``of(vectors)`` over all batches: added up per task, then per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            flat = np.ascontiguousarray(total).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "value"])

    cells = fit.select("x").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    rows = sorted((r.cell, r.value) for r in cells.collect())  # as many as the block has numbers
    return np.array([value for _, value in rows], np.int64 if kind == "long" else np.float64)


def _centring(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n in doubles; the whole part of the mean is taken off in integers, so nothing cancels."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - rest


def _moments(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors, and the exact sum of every dimension, added up in two halves that cannot overflow."""
    mask = (1 << _LOW_BITS) - 1

    def of(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> _LOW_BITS).sum(axis=0), (x & mask).sum(axis=0)]).astype(np.int64)

    found = _totals(fit, of, "long")
    if not len(found):
        return 0, ()
    high, low = np.split(found[1:], 2)
    return int(found[0]), tuple((int(h) << _LOW_BITS) + int(l) for h, l in zip(high, low))


def _filtered(product: Callable, q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance, times q: at most 1 on [0, cut], and scaled to about 1 at ``top``."""
    half = cut / 2
    sigma = sigma_1 = half / (top - half)
    before, now = q, (vq - half * q) * (sigma_1 / half)
    for _ in range(degree - 1):
        following = 1 / (2 / sigma_1 - sigma)
        before, now = now, 2 * (following / half) * (product(now) - half * now) - sigma * following * before
        sigma = following
    return now


def train(fit: DataFrame, components: int = COMPONENTS, degree: int = DEGREE, seed: int = 42) -> Model | None:
    """The leading components of the vectors ``x`` of ``fit``, each counted as often as it stands there.

    The block has twice the wanted directions. A round that brings the residual down by less than ten doubles it, up
    to all dimensions, where Rayleigh-Ritz alone is exact. Components whose share of the variance is rounding are left out.
    None without vectors or without dimensions. What the driver and a task hold grows with the square of the dimensions alone.
    """
    n, sums = _moments(fit)
    d = len(sums)
    if not d:
        return None
    centred = _centring(n, sums)
    trace = float(_totals(fit, lambda x: np.square(centred(x)).sum(axis=0).sum(keepdims=True), "double")[0]) / n
    wanted = min(components, d)
    if trace == 0:
        return Model(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0, 0.0)

    def product(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return _totals(fit, of, "double").reshape(q.shape) / n

    random = np.random.default_rng(seed)
    q = np.linalg.qr(random.standard_normal((d, min(d, 2 * wanted))))[0]
    residual = previous = np.inf
    for rounds in range(1, MOST_ROUNDS + 1):
        vq = product(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / values[0])
        stuck = residual > previous / 10
        if residual <= RESIDUAL or (residual <= LAST_RESIDUAL and stuck) or q.shape[1] == d:
            break
        previous = residual
        y = _filtered(product, q, vq, values[-1], values[0], degree) if values[-1] > 0 else vq
        if stuck:
            y = np.hstack([y / np.abs(y).max(), random.standard_normal((d, min(q.shape[1], d - q.shape[1])))])
        q = np.linalg.qr(y)[0]
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds, residual {residual}")
    kept = [i for i in range(wanted) if values[i] > LEAST_SHARE * trace]
    return Model(n, sums, q[:, kept], values[kept], trace, rounds, residual)


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    centred, turn = _centring(model.n, model.sums), model.components / np.sqrt(model.eigenvalues)

    def of(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn
        return np.concatenate([(w.T @ w).reshape(-1), w.sum(axis=0)])

    found = _totals(fit, of, "double") / model.n
    mean = found[k * k :]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """sum of (n x - S)^2 per row, exact; None where it exceeds a long."""
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    near = np.abs((x - whole).astype(np.float64)).max(initial=0) + 1
    if near * near * n * n * len(sums) < 2**62:
        off = n * (x - whole) - np.array(rest, np.int64)
        return np.square(off).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whitened(rows: DataFrame, model: Model, error: float, key: str = "vec_id") -> DataFrame:
    """Per row of ``x`` and component: the key, component (from 1), n, deviation, whitened, explained, identity_error.

    The deviation, sum of (n x - S)^2, is null where it exceeds a long. Repeated rows stay repeated.
    """
    k = len(model.eigenvalues)
    centred, turn = _centring(model.n, model.sums), model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace if k else np.zeros(0)
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x = _matrix(batch.column("x"))
            each = np.repeat(np.arange(m), k)
            deviation = pa.array(_deviations(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), deviation.take(pa.array(each)), pa.array((centred(x) @ turn).reshape(-1)),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    fields = f"key {types[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(F.col(f"`{key}`").alias("key"), "x").mapInArrow(run, fields).withColumnRenamed("key", key)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened coordinates of all whole vectors, fitted on every distinct vector once; see on_lattice and whitened.

    A null key stays null; other columns are not read. No vector, or no variance, gives no row. Runs jobs when
    called and writes the distinct vectors below the shared folder; hot vectors are combined before that shuffle.
    """
    named = rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{vector}`").alias(vector))
    on = on_lattice(named, vector).select(key, "x")
    fit = stage(on.select("x").distinct(), "vectors")
    model = train(fit, components)
    if model is None:
        model = Model(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0, 0.0)
        return whitened(on, model, 0.0, key)
    return whitened(on, model, identity_error(fit, model), key)
