"""Whitening of embeddings by LOBPCG on their covariance.

Entries become whole numbers, x = floor(1024 c) + 100000, so that sums and deviations are exact. The leading eigenvectors
of the covariance are found without ever building it: a step asks the cluster for the product of the covariance with a
block of directions, each task summing C'(CU) over its centred rows C and sending one small block. On the driver, where
all arrays have a row per dimension and a few dozen columns, Rayleigh-Ritz picks the best block from the space of the
iterate, its residuals and the previous directions. Guard directions besides the wanted ones speed that up. It ends when
the wanted residuals, taken from a product of their own and not from recurrences, are certified to be small.

Defined cases: rows whose vector is null, or holds a null or non-finite entry, or has another length than most (the
shortest of equally common lengths) are dropped; an entry too large for a whole number of 53 bits is an error when rows
are read; repeated rows count as often as they occur; components without variance (eigenvalue at most 1e-12 of the
trace) are left out, so equal vectors give no components; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS, GUARDS = 8, 8
#: Residuals are certified at this share of the largest eigenvalue; beyond so many steps the fit is an error.
TOLERANCE, STEPS = 1e-13, 500
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    #: A unit eigenvector a column, with its eigenvalue; the sum of all eigenvalues.
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    #: Residual norms over the largest eigenvalue, and distributed steps.
    residuals: np.ndarray
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def scaled(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): the rows that count, their entries as whole numbers."""
    entries = F.col(vector).cast("array<double>")
    good = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = rows.select(F.col(key), entries.alias("__c")).where(F.col("__c").isNotNull() & (F.size("__c") > 0) & good)
    usual = kept.groupBy(F.size("__c").alias("__d")).count().orderBy(F.desc("count"), "__d").first()
    high = F.raise_error(F.lit("an entry is too large to be a whole number of 53 bits")).cast("double")
    whole = F.transform("__c", lambda c: F.floor(F.when(F.abs(c) < float(1 << 53) / SCALE, c * SCALE).otherwise(high)) + SHIFT)
    return kept.where(F.size("__c") == (usual["__d"] if usual else 0)).select(key, whole.cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.asarray(column.flatten()).astype(dtype).reshape(len(column), -1)


def _summed(vectors: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of what `of_rows` makes of a matrix of them; a task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_rows(_matrix(batch.column(0), "i8")).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["part"])

    parts = vectors.select("x").mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "v"))
    return np.array([r.v for r in parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()])


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """A basis of what the columns span beside `against`; columns that add nothing drop out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for other in against:
            block = block - other @ (other.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s[0])]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guards: int = GUARDS, tolerance: float = TOLERANCE, most: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Leading eigenvectors, eigenvalues and certified residuals of a symmetric operator, and the products it took."""
    size = min(dims, wanted + guards)
    wanted = min(wanted, dims)
    x = _orthonormal(np.random.default_rng(7).standard_normal((dims, size)))
    ax, p, ap, products = product(x), np.empty((dims, 0)), np.empty((dims, 0)), 1
    fresh = True  # ax comes from a product, not from recurrences
    while True:
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        rest = ax - x * values
        norms = np.linalg.norm(rest, axis=0)
        top = max(abs(values[0]), np.finfo(float).tiny)
        if (norms[:wanted] <= tolerance * top).all():
            if fresh:
                return x[:, :wanted], values[:wanted], norms[:wanted] / top, products
            x = np.linalg.qr(x)[0]
            ax, p, ap, fresh = product(x), np.empty((dims, 0)), np.empty((dims, 0)), True
            products += 1
            continue
        if products >= most:
            raise RuntimeError(f"residuals of {norms[:wanted].max() / top:.1e} after {products} products")
        w = _orthonormal(rest[:, norms > 1e-15 * top], x, p)
        if not w.shape[1]:  # the space is exhausted to rounding
            if fresh:
                return x[:, :wanted], values[:wanted], norms[:wanted] / top, products
            tolerance = max(tolerance, float(norms[:wanted].max()) / top * 2)
            continue
        aw = product(w)
        products, fresh = products + 1, False
        basis, images = np.hstack([x, w, p]), np.hstack([ax, aw, ap])
        small = basis.T @ images
        _, best = np.linalg.eigh((small + small.T) / 2)
        best = best[:, ::-1][:, :size]
        # The new directions: what the step adds from residuals and old directions, made orthogonal to the new iterate.
        away = best.copy()
        away[:size] = 0
        away = _orthonormal(away, best)
        x, ax, p, ap = basis @ best, images @ best, basis @ away, images @ away


def fit(vectors: DataFrame, components: int = COMPONENTS, guards: int = GUARDS, tolerance: float = TOLERANCE) -> Whitening | None:
    """The leading components of `scaled` rows, already checkpointed; None without rows."""
    sums = _summed(vectors, lambda x: np.r_[x.sum(axis=0), len(x)], "bigint")
    if not len(sums):
        return None
    *sums, n = (int(s) for s in sums)
    mean, dims = np.array([s / n for s in sums]), len(sums)
    trace = float(_summed(vectors, lambda x: np.array([((x - mean) ** 2).sum()]), "double")[0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        def of_rows(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(vectors, of_rows, "double").reshape(block.shape) / n

    if trace <= 0:
        return Whitening(n, sums, np.empty((dims, 0)), np.empty(0), 0.0, np.empty(0), 0)
    axes, variances, residuals, steps = lobpcg(product, dims, components, guards, tolerance)
    kept = variances > NO_VARIANCE * trace
    return Whitening(n, sums, axes[:, kept], variances[kept], trace, residuals[kept], steps)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    mean, turn, r = model.mean, model.axes / np.sqrt(model.variances), len(model.variances)

    def of_rows(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ turn
        return white.T @ white

    return float(np.abs(_summed(vectors, of_rows, "double").reshape(r, r) / model.n - np.eye(r)).max()) if r else 0.0


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Per row the exact sum of (n x - S)^2."""
    largest = max(n * int(np.abs(x).max()) + max(map(abs, sums)), 1)
    if largest < 1 << 62:
        away = n * x - np.array(sums, "i8")
        if x.shape[1] * int(np.abs(away).max()) ** 2 < 1 << 63:
            return pa.array((away**2).sum(axis=1)).cast(pa.decimal128(38, 0))
    away = n * x.astype(object) - np.array(sums, object)
    return pa.array([str(v) for v in (away**2).sum(axis=1)]).cast(pa.decimal128(38, 0))


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """Per row: key, deviation and its whitened coordinates, one per component."""
    mean, turn, n, sums = model.mean, model.axes / np.sqrt(model.variances), model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), "i8")
                white = pa.array(list((x - mean) @ turn), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _deviations(x, n, sums), white], [key, "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "x").mapInArrow(run, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")


def components(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    vectors = checkpoint(scaled(rows))
    model = fit(vectors, most)
    if model is None:
        model = Whitening(1, [0], np.empty((1, 0)), np.empty(0), 1.0, np.empty(0), 0)
    shares = F.array(*(F.lit(float(v) / model.trace) for v in model.variances)) if len(model.variances) else F.array().cast("array<double>")
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"),
    )
