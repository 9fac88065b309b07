"""Whitening of embeddings by block subspace iteration that never builds a covariance.

1. Entries become whole numbers, so that the number of rows, the sums S and each row's deviation n*x - S are exact.
   Rows are centred by that exact deviation before anything is multiplied.
2. A pass over the table gives V Q = X'(X Q) / n for a block Q of directions: a task multiplies its rows batch by batch
   and gives one d x p matrix, whose rows are summed by their number in a shuffle with partial sums.
3. Blocks are made orthonormal by QR against those before them, and a Rayleigh-Ritz step over the subspace of all
   blocks kept gives eigenvalues and vectors. The residual V u - e u of each of the k components is known without
   another pass. While one is above ``TOLERANCE``, the residuals are the next block. Beyond ``KEPT`` blocks the
   subspace is narrowed to its best vectors. A subspace of all dimensions has no residual but rounding.
4. A pass over whitened rows measures how far their covariance is from the identity; a last one writes them.

The driver holds d x p matrices, whose size depends on the number of dimensions only; tasks get Q with the function.

Rows whose vector is null, or holds null or non-finite entries, are left out. A vector shorter than the longest lacks
entries and is left out too. Directions without variance (below ``RANK`` of the largest eigenvalue) can't be whitened
and have no rows, so equal vectors alone give an empty result, as an empty table does. Repeated rows count each; a
null vec_id is kept; other columns are ignored. Deviations that don't fit a long stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

COMPONENTS = 32
#: Directions of a block beyond the components, so that the last ones settle soon.
SPARE = 32
#: Blocks that a subspace holds before it is narrowed.
KEPT = 4
#: Largest norm of a component's residual, as a share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Least share of the largest eigenvalue that a component has.
RANK = 1e-11
PASSES = 500
SEED = 20260928
# fixed values: entries as whole numbers
SCALE, SHIFT = 64, 1_000_000


def vectors(embeddings: DataFrame, ids: bool = True) -> DataFrame:
    """Rows with finite entries only: embedding as doubles, and vec_id."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull()).where(whole).select(*(["vec_id"] if ids else []), value.alias("embedding"))


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of the batch's vectors of ``width`` entries, and which rows these are."""
    column = batch.column("embedding")
    rows = np.flatnonzero(np.asarray(column.value_lengths()) == width)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
    scaled = np.floor(SCALE * values)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("an entry doesn't fit a long")
    return scaled.astype(np.int64) + SHIFT, rows


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the longest vectors of a task: width, dimension, sum, their number and the largest absolute value."""
    width, total, n, most = 0, np.zeros(0, np.int64), 0, 0
    for batch in batches:
        longest = max(np.asarray(batch.column("embedding").value_lengths()).tolist(), default=0)
        if longest < max(width, 1):
            continue
        if longest > width:
            width, total, n, most = longest, np.zeros(longest, np.int64), 0, 0
        x, _ = _matrix(batch, width)
        if (abs(int(most)) + int(np.abs(x).max(initial=0))) * (n + len(x)) >= 1 << 62:
            raise OverflowError("sums of entries don't fit a long")
        total, n, most = total + x.sum(axis=0), n + len(x), max(most, int(np.abs(x).max(initial=0)))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(total), pa.array([n] * width, pa.int64())], names=["width", "dim", "total", "n"])


def centre(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors of the largest width and the sums of their whole numbers, exact."""
    parts = cut(rows.select("embedding").mapInArrow(_sums, "width int, dim int, total long, n long"))
    width = parts.agg(F.max("width").alias("w")).first()["w"] or 0
    # a row for each dimension
    found = parts.where(F.col("width") == width).groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    return (found[0]["n"] if found else 0), np.array([r["total"] for r in found], np.int64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact."""
    if x.size and (int(np.abs(x).max()) * n + int(np.abs(sums).max())) >= 1 << 63:
        raise OverflowError("n * x doesn't fit a long")
    return n * x - sums


def summed(rows: DataFrame, n: int, sums: np.ndarray, of: int, product) -> np.ndarray:
    """The sum over all rows of ``product`` of centred batches, a matrix with ``of`` columns, by its rows in a shuffle."""
    width = len(sums)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, _ = _matrix(batch, width)
            own = product(deviations(x, n, sums) / n)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, k]) for k in range(of))], names=["dim", *(f"c{k}" for k in range(of))])

    names = [f"c{k}" for k in range(of)]
    parts = rows.select("embedding").mapInArrow(part, "dim int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("dim").agg(*(F.sum(c).alias(c) for c in names)).collect()
    return np.array([[r[c] for c in names] for r in sorted(found, key=lambda r: r["dim"])]).reshape(-1, of)


def _orthonormal(block: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Directions of a block beside those kept, by QR twice; what is left of none is dropped."""
    for _ in range(2):
        block = block - kept @ (kept.T @ block)
        block, upper = np.linalg.qr(block)
        size = np.abs(np.diag(upper))
        block = block[:, size > 1e-10 * max(size.max(initial=0.0), 1e-300)]
    return block


def components(rows: DataFrame, n: int, sums: np.ndarray, k: int = COMPONENTS, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and eigenvectors (columns) of the k largest components, and the trace of the covariance.

    The trace is gathered with the first pass, as the diagonal's sums.
    """
    d = len(sums)
    k, p = min(k, d), min(d, k + spare)
    block, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, p)))
    kept, moved, trace = np.zeros((d, 0)), np.zeros((d, 0)), None
    for _ in range(PASSES):
        got = summed(rows, n, sums, block.shape[1] + 1, lambda y, q=block: np.column_stack([y.T @ (y @ q), (y * y).sum(axis=0)])) / n
        trace = float(got[:, -1].sum())
        kept, moved = np.column_stack([kept, block]), np.column_stack([moved, got[:, :-1]])
        small = kept.T @ moved
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residuals = moved @ turn[:, :p] - (kept @ turn[:, :p]) * values[:p]
        sizes = np.linalg.norm(residuals[:, :k], axis=0)
        if kept.shape[1] >= d or sizes.max() <= TOLERANCE * max(values[0], 0.0):
            found = values[:k] > RANK * max(values[0], 0.0)
            return values[:k][found], (kept @ turn[:, :k])[:, found], trace
        if kept.shape[1] + p > max(KEPT * p, 2 * p):
            kept, moved = kept @ turn[:, :p], moved @ turn[:, :p]
        block = _orthonormal(residuals, kept)[:, : d - kept.shape[1]]
        if not block.shape[1]:
            block = _orthonormal(np.random.default_rng(SEED + kept.shape[1]).standard_normal((d, min(p, d - kept.shape[1]))), kept)
    raise ArithmeticError(f"components aren't certified after {PASSES} passes")


def whiten(spark: SparkSession, embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    rows = vectors(embeddings)
    n, sums = centre(rows)
    values, basis, trace = components(rows, n, sums, k) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    if not len(values):
        return spark.createDataFrame([], f"vec_id {id_type}, {kind}")
    scaled, m = basis / np.sqrt(values), len(values)

    def spread(y: np.ndarray) -> np.ndarray:
        z = y @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    moments = summed(rows, n, sums, m, spread) / n
    error = float(np.abs(moments[:m] - np.outer(moments[m], moments[m]) - np.eye(m)).max())
    shares = values / trace
    width = len(sums)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch, width)
            y = deviations(x, n, sums)
            if y.size and (np.abs(y).max(axis=1).astype(float) ** 2 * width).max() >= 2.0**63:
                squares = [sum(int(v) ** 2 for v in r) for r in y]  # pyarrow refuses those beyond a long
            else:
                squares = (y * y).sum(axis=1)
            count = len(own)
            ids = batch.column("vec_id").take(pa.array(np.repeat(own, m)))
            columns = [ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, n)), pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(count), m))), pa.array(((y / n) @ scaled).ravel()), pa.array(np.tile(shares, count)), pa.array(np.full(count * m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(write, f"vec_id {id_type}, {kind}")
