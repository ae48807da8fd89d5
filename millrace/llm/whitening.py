"""Embedding whitening by shifted CholeskyQR.

Vectors become whole numbers x = floor(scale * c); the fit list holds each distinct x once, in a written table. Its centred rows A are
orthogonalised by distributed Gram passes: each pass sums the Gram matrix of the rows after the triangular solves of the passes before,
its Cholesky factor (with a shift where rounding could make the matrix indefinite) is one more R, and A = Q R for the product R of all of
them. An SVD of R then gives the covariance's eigenvectors and eigenvalues without squaring the condition of A. What passes through the driver
are matrices of dimensions by dimensions; rows stay in Spark.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped; a vector shorter than the longest counts as
zero in the dimensions it lacks (an empty one in all); entries beyond a long saturate; equal vectors are one row of the fit list and get
equal results each; null and repeated ids pass through; other columns are ignored. A component whose eigenvalue is zero to working precision can't be
whitened and is left out, so that an empty table, or one of a single distinct vector, gives no row. ``deviation`` is null where it exceeds a long. More than
``MOST_DIMENSIONS`` dimensions are an error, as the driver holds matrices of their square. A component's largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_arrow
from millrace.llm.common import Scratch, table, tidy

#: Factor before rounding down, components given, and dimensions at most.
SCALE, COMPONENTS, MOST_DIMENSIONS = 256, 4, 2048
#: Gram passes at most, and how far from orthonormal rows may end.
PASSES, SETTLED = 6, 1e-13
_EPS = float(np.finfo(np.float64).eps)
_LONG = (1 << 63) - 1


def whole(vector: Column, scale: int = SCALE) -> Column:
    """A vector's entries as long floor(scale * c); null where it is null or has a null or non-finite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))))


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Lists of longs as the rows of a matrix, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    lengths = np.diff(ends)
    if lengths.size and (lengths == dimensions).all():
        return values[ends[0] : ends[-1]].reshape(lengths.size, dimensions)
    out = np.zeros((lengths.size, dimensions), np.int64)
    rows = np.repeat(np.arange(lengths.size), lengths)
    out[rows, np.arange(values[ends[0] : ends[-1]].size) - np.repeat(ends[:-1] - ends[0], lengths)] = values[ends[0] : ends[-1]]
    return out


@dataclass(frozen=True)
class Fit:
    """What a fit list is centred by: its number of rows and its exact sums."""

    n: int
    sums: tuple[int, ...]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they suffice, whole numbers of Python otherwise."""
        bound = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if 0 <= bound <= _LONG and x.size and x.min() > -_LONG else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.spread(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exactly; None beyond a long."""
        d = self.spread(x)
        if d.dtype == object or (d.size and int(np.abs(d).max()) ** 2 * d.shape[1] > _LONG):
            exact = [sum(v * v for v in row) for row in d.astype(object).tolist()]
            return [v if v <= _LONG else None for v in exact]
        return (d * d).sum(axis=1).tolist()


def fit_list(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, Fit]:
    """Each distinct ``x`` once, as a written table; its dimensions; its rows and sums."""
    found = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if found > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {found} dimensions, more than {MOST_DIMENSIONS}")
    filled = F.when(F.size("x") == found, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(found) - F.size("x"))))
    rows = scratch.save(vectors.select(filled.alias("x")).distinct(), "fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(found, object)
        for batch in batches:
            x = matrix(batch.column(0), found)
            n += len(x)
            small = not x.size or (x.min() > -(1 << 40) and x.max() < 1 << 40)
            total += (x.sum(axis=0) if small and len(x) < 1 << 20 else x.astype(object).sum(axis=0)).astype(object)
        yield pa.RecordBatch.from_pydict({"dimension": list(range(-1, found)), "total": [str(n), *map(str, total)]}, pa.schema([("dimension", pa.int32()), ("total", pa.string())]))

    parts = map_arrow(rows, sums, "dimension int, total string")
    summed = {r.dimension: int(r.s) for r in parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each dimension
    return rows, found, Fit(summed.get(-1, 0), tuple(summed.get(i, 0) for i in range(found)))


def gram(rows: DataFrame, dimensions: int, transformed: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of products of all pairs of transformed columns: each task's own matrix, whose upper cells Spark sums."""
    width = transformed(np.zeros((1, dimensions), np.int64)).shape[1]
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            q = transformed(matrix(batch.column(0), dimensions))
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(upper[0].size), pa.int32()), pa.array(total[upper])], ["cell", "value"])

    with tidy(rows.sparkSession):
        cells = map_arrow(rows, run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((width, width))
    flat = np.zeros(upper[0].size)
    flat[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    out[upper] = flat
    return out + np.triu(out, 1).T


def solved(factors: list[np.ndarray], a: np.ndarray) -> np.ndarray:
    """a times the inverses of upper triangular factors, first one first, by back substitution over columns."""
    q = a
    for r in factors:
        out = np.empty_like(q)
        for j in range(r.shape[0]):
            out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        q = out
    return q


def shifted_factor(g: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular R with R' R = G + s I; s is what rounding may take from the least eigenvalue, or 0 if that is safe."""
    d, norm = len(g), float(np.linalg.norm(g, 2))
    shift = 11 * (n * d + d * (d + 1)) * _EPS / 2 * norm
    shift = min(max(shift, 4 * d * _EPS * norm), norm)
    least = float(np.linalg.eigvalsh(g)[0])
    s = 0.0 if least > 100 * shift or least > 0.5 * norm else shift
    return np.linalg.cholesky(g + s * np.eye(d)).T


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors (columns) with their eigenvalues, falling, of a fit list's covariance, and its trace."""

    fit: Fit
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        return self.fit.centred(x) @ self.components / np.sqrt(self.values)


def orthogonalise(rows: DataFrame, dimensions: int, fit: Fit, components: int = COMPONENTS) -> Whitening:
    """Shifted CholeskyQR of the centred fit list, and the leading components from the SVD of its R."""
    factors: list[np.ndarray] = []
    r = np.eye(dimensions)
    g = gram(rows, dimensions, fit.centred)
    trace = float(np.trace(g)) / fit.n
    if trace > 0:
        for _ in range(PASSES):
            factor = shifted_factor(g, fit.n)
            factors.append(factor)
            r = factor @ r
            g = gram(rows, dimensions, lambda x, now=tuple(factors): solved(list(now), fit.centred(x)))
            ends = np.linalg.eigvalsh(g)
            if ends[0] > 1 - SETTLED * dimensions and ends[-1] < 1 + SETTLED * dimensions:
                break
    # Directions without extent never become orthonormal: what is left of the last Gram matrix stands between Q and R.
    own, axes = np.linalg.eigh(g)
    _, sigma, axis = np.linalg.svd(np.sqrt(np.maximum(own, 0))[:, None] * (axes.T @ r)) if trace > 0 else (None, np.zeros(0), np.zeros((0, dimensions)))
    kept = int((sigma[:components] > dimensions * _EPS * sigma[0]).sum()) if sigma.size else 0
    w = axis[:kept].T
    if kept:
        w = w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(kept)])
    return Whitening(fit, w, sigma[:kept] ** 2 / fit.n, trace)


def identity_error(rows: DataFrame, dimensions: int, found: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance (centred by its own means) minus the identity."""
    k, n = len(found.values), found.fit.n
    ones = gram(rows, dimensions, lambda x: np.hstack([np.ones((len(x), 1)), found.project(x)]))
    means = ones[0, 1:] / n
    own = gram(rows, dimensions, lambda x: found.project(x) - means)
    return float(np.abs(own / n - np.eye(k)).max())


def whiten(frame: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row with a whole vector and each component."""
    vectors = frame.select(F.col(id_column).alias("id"), whole(F.col(vector_column), scale).alias("x")).where(F.col("x").isNotNull())
    rows, dimensions, fit = fit_list(vectors, scratch)
    schema = f"{id_column} {frame.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = orthogonalise(rows, dimensions, fit, components) if fit.n and dimensions else None
    if found is None or not len(found.values):
        return frame.sparkSession.createDataFrame([], schema)
    k, error, shares = len(found.values), identity_error(rows, dimensions, found), found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimensions)
            m, each = len(x), np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(found.project(x).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(vectors, run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened coordinates of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"), Scratch(spark, "whitening"))
