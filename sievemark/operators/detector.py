"""Detectors of one class of vectors against another: scaling on train rows, logistic grid, mean-shift direction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .additive import class_shift, standardise
from .ranking import running_total

# fixed values: the grid, iterations and tolerance of the detector
C_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
MAX_ITERATIONS = 10_000
TOLERANCE = 1e-9


def scaled_vectors(rows: DataFrame, key: list[str], vector: str, train: str, group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``vector`` standardised by its train rows, population deviation, constants left at 0."""
    parts = rows.select(*key, F.posexplode(vector).alias("dim", "v"))
    scaled = standardise(parts, train, group)
    back = scaled.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias(vector))
    return back


def shift_scores(rows: DataFrame, key: list[str], vector: str, train: str, positive: str, group: list[str] | None = None) -> DataFrame:
    """Scores on the direction of the class shift of the scaled train rows (of each ``group``); all three are over ``key``."""
    scaled = standardise(rows.select(*key, F.posexplode(vector).alias("dim", "v")), train, group)
    shift = class_shift(scaled.where(train), group or [], positive).withColumnRenamed("v", "w")
    return scaled.join(shift, [*(group or []), "dim"]).groupBy(*key).agg(F.sum(F.col("v") * F.col("w")).alias("score"))


def paired_scores(scored: DataFrame, source: str, positive: str, cell: str = "cell") -> DataFrame:
    """Rows (cell, source, human, generated) from scored rows of both classes."""
    side = lambda made: F.max(F.when(F.expr(positive) == F.lit(made), F.col("score")))
    return scored.groupBy(cell, F.col(source).alias("source")).agg(side(False).alias("human"), side(True).alias("generated"))


def logistic_grids(rows: DataFrame, cell: str, vector: str, positive: str, split: str, grid: tuple[float, ...] = C_GRID, max_iterations: int = MAX_ITERATIONS) -> tuple[DataFrame, list[tuple[object, float, float]]]:
    """``rows`` with ``selected_c`` and ``score``, and the grid as (cell, C, validation AUROC).

    A cell's model is that of the best validation AUROC, the smallest C among equals. C's penalty is |w|^2 / 2C beside
    the summed loss, without the intercept. All cells and values of C are fitted together by damped Newton steps: a step
    is one pass over the train rows, whose sums of gradients and curvatures are added in two levels and solved in the
    tasks; the driver holds a vector for each fit. A fit that doesn't converge is an error. Cells that lack a class in
    the train or validation rows, and a null cell, have null scores. Vectors have to be finite and of one length.
    """
    data = cut(rows.withColumn(_VECTOR, F.transform(vector, lambda x: x.cast("double"))).withColumn(_LABEL, F.expr(positive).cast("double")))
    several = data.where(F.col(split).isin("train", "val") & F.col(cell).isNotNull()).groupBy(cell).agg(F.count_distinct(_LABEL, split).alias("n")).where("n = 4")
    cells = sorted(r[0] for r in several.select(cell).collect())
    fits = [(own, c) for own in cells for c in sorted(grid)]
    weights = _newton(data.where(F.col(split) == "train").select(cell, _VECTOR, _LABEL), cell, fits, max_iterations) if fits else []
    margins = _margins(data.where(F.col(split) == "val").select(cell, _VECTOR, _LABEL), cell, fits, weights)
    held = {r["fit"]: r["auroc"] for r in _class_aurocs(margins).collect()}
    tried = [(own, c, held[k]) for k, (own, c) in enumerate(fits)]
    best: dict[object, int] = {}
    for k, (own, _, value) in enumerate(tried):
        if own not in best or value > tried[best[own]][2]:
            best[own] = k
    chosen = {own: (fits[k][1], weights[k]) for own, k in best.items()}
    return _scored(data, cell, chosen).drop(_VECTOR, _LABEL), tried


def logistic_grid(rows: DataFrame, vector: str, positive: str, split: str, grid: tuple[float, ...] = C_GRID, max_iterations: int = MAX_ITERATIONS) -> tuple[DataFrame, float, list[tuple[float, float]]]:
    """``logistic_grids`` of rows that are one cell: scored rows, the selected C, and the grid."""
    scored, tried = logistic_grids(rows.withColumn("_cell", F.lit(0)), "_cell", vector, positive, split, grid, max_iterations)
    if not tried:
        raise ValueError("train and validation rows need both classes")
    best = max(value for _, _, value in tried)
    return scored.drop("_cell", "selected_c"), min(c for _, c, value in tried if value == best), [(c, value) for _, c, value in tried]


_VECTOR, _LABEL = "_vector", "_label"
#: Partial sums that a task holds before it hands them on.
_HELD = 256
#: Partitions whose sums are added first.
_LEVEL = 64
_SUMS = "fit int, part int, n long, loss double, slope binary, curve binary"


def _by_cell(batch: pa.RecordBatch, cell: str) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """Cells of a batch, their rows, and these rows' vectors with a one for the intercept."""
    if not len(batch):
        return
    x = batch.column(_VECTOR).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    x = np.concatenate((x, np.ones((len(batch), 1))), axis=1)
    coded = batch.column(cell).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy()
    for k, own in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero(codes == k)
        yield own, at, x[at]


def _newton(train: DataFrame, cell: str, fits: list[tuple[object, float]], max_iterations: int) -> list[np.ndarray]:
    """The minimum of every fit (cell, C)."""
    train = cut(train)
    size = train.select(F.size(_VECTOR)).first()[0] + 1
    at = {k: np.zeros(size) for k in range(len(fits))}
    base: dict[int, tuple[np.ndarray, float]] = {}
    step: dict[int, np.ndarray] = {}
    done: dict[int, np.ndarray] = {}
    for _ in range(max_iterations):
        for k, loss, steepest, direction in _steps(train, cell, fits, at):
            if k in base and loss > base[k][1] + 1e-12 * abs(base[k][1]):
                step[k] = step[k] / 2
                at[k] = base[k][0] + step[k]
            elif steepest <= TOLERANCE:
                done[k] = at.pop(k)
            else:
                base[k], step[k] = (at[k], loss), direction
                at[k] = at[k] + direction
        if not at:
            return [done[k] for k in range(len(fits))]
    own, c = fits[min(at)]
    raise RuntimeError(f"no convergence of {len(at)} fits, such as of cell {own} at C = {c}")


def _steps(train: DataFrame, cell: str, fits: list[tuple[object, float]], at: dict[int, np.ndarray]) -> list[tuple[int, float, float, np.ndarray]]:
    """Loss, steepest mean slope and Newton step of every fit that is still going, at its weights ``at``."""
    going: dict[object, list[tuple[int, np.ndarray]]] = {}
    for k, w in at.items():
        going.setdefault(fits[k][0], []).append((k, w))
    most = _HELD
    sent = train.sparkSession.sparkContext.broadcast((going, {k: (fits[k][1], w) for k, w in at.items()}))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}

        def told() -> pa.RecordBatch:
            rows = [(k, part, n, loss, slope.tobytes(), curve.tobytes()) for k, (n, loss, slope, curve) in held.items()]
            return _batch(rows)

        for batch in batches:
            labels = batch.column(_LABEL).to_numpy()
            for own, rows, x in _by_cell(batch, cell):
                y = labels[rows]
                for k, w in sent.value[0].get(own, ()):
                    z = x @ w
                    p = 0.5 * (1 + np.tanh(z / 2))
                    found = (len(y), float((np.logaddexp(0, z) - y * z).sum()), x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x)
                    held[k] = [a + b for a, b in zip(held[k], found, strict=True)] if k in held else list(found)
                if len(held) >= most:
                    yield told()
                    held = {}
        if held:
            yield told()

    def add(table: pa.Table) -> pa.RecordBatch:
        return _batch([(table.column("fit")[0].as_py(), 0, *_added(table))])

    def solve(table: pa.Table) -> pa.Table:
        k = table.column("fit")[0].as_py()
        n, loss, slope, curve = _added(table, packed=False)
        c, w = sent.value[1][k]
        free = np.append(w[:-1], 0.0)
        loss, slope = loss + free @ free / (2 * c), slope + free / c
        curve = curve + np.diag(np.append(np.full(len(w) - 1, 1 / c), 0.0))
        direction = -np.linalg.lstsq(curve, slope, rcond=None)[0]
        return pa.table({"fit": pa.array([k], pa.int32()), "loss": [loss], "steepest": [float(np.abs(slope).max() / n)], "direction": pa.array([direction.tobytes()], pa.binary())})

    level = train.mapInArrow(sums, _SUMS).withColumn("part", F.floor(F.col("part") / _LEVEL).cast("int"))
    level = level.groupBy("fit", "part").applyInArrow(lambda table: pa.Table.from_batches([add(table)]), _SUMS)
    told = level.groupBy("fit").applyInArrow(solve, "fit int, loss double, steepest double, direction binary").collect()
    return [(r["fit"], r["loss"], r["steepest"], np.frombuffer(bytes(r["direction"]))) for r in told]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["fit", "part", "n", "loss", "slope", "curve"])


def _added(table: pa.Table, packed: bool = True) -> tuple:
    """Sums of the rows of one fit; in an order of their own, so that reruns agree."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "loss", "slope", "curve")), strict=True))
    slope = sum(np.frombuffer(r[2]) for r in rows)
    curve = sum(np.frombuffer(r[3]) for r in rows)
    n, loss = sum(r[0] for r in rows), sum(r[1] for r in rows)
    return (n, loss, slope.tobytes(), curve.tobytes()) if packed else (n, loss, slope, curve.reshape(len(slope), -1))


def _margins(held: DataFrame, cell: str, fits: list[tuple[object, float]], weights: list[np.ndarray]) -> DataFrame:
    """(fit, label, score) of every row under every fit of its cell."""
    own: dict[object, list[int]] = {}
    for k, (name, _) in enumerate(fits):
        own.setdefault(name, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(_LABEL).to_numpy()
            for name, rows, x in _by_cell(batch, cell):
                for k in own.get(name, ()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(labels[rows]), pa.array(x @ weights[k])], names=["fit", "label", "score"])

    return held.mapInArrow(run, "fit int, label double, score double")


def _class_aurocs(margins: DataFrame) -> DataFrame:
    """(fit, auroc) of scored rows of both classes: wins and half the ties over all pairs, by running totals."""
    hist = margins.groupBy("fit", "score").agg(F.count_if(F.col("label") == 0).alias("h"), F.count_if(F.col("label") == 1).alias("m"))
    counted = running_total(hist, ["fit"], "score", {"below": F.col("h")})
    wins = F.sum(F.col("m") * (2 * F.col("below") + F.col("h")))
    return counted.groupBy("fit").agg((wins / (2 * F.sum("h") * F.sum("m"))).alias("auroc"))


def _scored(data: DataFrame, cell: str, chosen: dict[object, tuple[float, np.ndarray]]) -> DataFrame:
    """All rows with their cell's C and their score, null where the cell has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, score = np.zeros(len(batch)), np.zeros(len(batch))
            none = np.ones(len(batch), dtype=bool)
            for name, rows, x in _by_cell(batch, cell):
                if name in chosen:
                    c[rows], w = chosen[name]
                    score[rows], none[rows] = x @ w, False
            added = [pa.array(v, mask=none) for v in (c, score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "selected_c", "score"])

    return data.mapInArrow(run, data.withColumns({"selected_c": F.lit(None).cast("double"), "score": F.lit(None).cast("double")}).schema)
