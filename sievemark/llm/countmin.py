"""Count-min sketches of chunks, merged by ranges of cells.

A chunk describes its keys by cells and counts, which are merged by adding. The merged sketch keeps a frequency class for
every cell and gives a key the smallest class of its cells, so a key's class is never below the class of its true count.

A merged sketch is never brought together. Chunks of the input send their cells to the owners of cell ranges, and get
a class back for each; cells grow with the corpus without a limit, and an owner's range stays ``OWNER_CELLS``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs

#: Cells of the smallest sketch.
LEAST_CELLS = 1 << 16
#: Cells of one owner: what a group of ``answers`` counts in, 16 MB.
OWNER_CELLS = 1 << 22
ASKED_SCHEMA = "owner int, chunk int, cells binary, counts binary"
TOLD_SCHEMA = "chunk int, owner int, classes binary"


def cell_numbers(keys: np.ndarray, cells: int, depth: int) -> list[np.ndarray]:
    """The cells of every key, one array for each row of the sketch."""
    mask = np.uint64(cells - 1)
    out = [(keys & mask).astype(np.int64)]
    for row in range(1, depth):
        out.append(((keys * np.uint64(0xD6E8FEB86659FD93 + 2 * row) >> np.uint64(29)) & mask).astype(np.int64))
    return out


def _classes(counts: np.ndarray, bounds: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.asarray(bounds), counts, side="right").astype(np.uint8)


def growing_cells(keys: int, per_key: float) -> int:
    """The number of cells for about ``keys`` keys, however many: a power of two."""
    return 1 << (max(LEAST_CELLS, int(keys * per_key)) - 1).bit_length()


def _by_owner(at: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, first, end) of each owner's run of ascending cells."""
    owner = at // OWNER_CELLS
    edges = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
    return [(int(owner[a]), a, b) for a, b in zip(edges, [*edges, len(at)][1:], strict=True)]


def questions(chunk: int, keys: np.ndarray, cells: int, depth: int) -> pa.Table:
    """A chunk's sketch, cut up by owners: its distinct cells and their counts, up to 65,535."""
    at, counts = np.unique(np.concatenate(cell_numbers(keys, cells, depth)), return_counts=True)
    runs = _by_owner(at)
    offsets, counts = (at % OWNER_CELLS).astype("<u4"), np.minimum(counts, 65535).astype("<u2")
    return pa.table(
        [
            pa.array([o for o, _, _ in runs], pa.int32()),
            pa.array([chunk] * len(runs), pa.int32()),
            pa.array([bs.planes(np.diff(offsets[a:b], prepend=offsets.dtype.type(0))) for _, a, b in runs], pa.binary()),
            pa.array([bs.planes(counts[a:b]) for _, a, b in runs], pa.binary()),
        ],
        names=["owner", "chunk", "cells", "counts"],
    )


def answers(table: pa.Table, bounds: tuple[int, ...] = (2, 16, 256)) -> pa.Table:
    """The merged cells of one owner's range: for each chunk's cells the classes of their counts in all, two bits each.

    ``bounds`` are the smallest counts of classes 1, 2 and 3, 65,535 at most.
    """
    counts = np.zeros(OWNER_CELLS, dtype=np.uint32)
    asked = []
    for cells, n in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist(), strict=True):
        at = np.cumsum(bs.unplanes(cells, "<u4"), dtype=np.int64)
        counts[at] += bs.unplanes(n, "<u2")
        asked.append(at.astype(np.uint32))
    told = []
    for at in asked:
        c = np.zeros(-(-len(at) // 4) * 4, dtype=np.uint8)
        c[: len(at)] = _classes(counts[at], bounds)
        c = c.reshape(-1, 4)
        told.append((c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes())
    return pa.table([table.column("chunk"), table.column("owner"), pa.array(told, pa.binary())], names=["chunk", "owner", "classes"])


def classes(keys: np.ndarray, told: pa.Table, cells: int, depth: int) -> np.ndarray:
    """The class of every key of a chunk, the smallest of its cells'; ``keys`` are those of ``questions``, in any order."""
    at, place = np.unique(np.concatenate(cell_numbers(keys, cells, depth)), return_inverse=True)
    packed = dict(zip(told.column("owner").to_pylist(), told.column("classes").to_pylist(), strict=True))
    parts = [np.zeros(0, np.uint8)]
    for owner, a, b in _by_owner(at):
        four = np.frombuffer(packed[owner], np.uint8)
        parts.append((four[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[: b - a])
    return np.concatenate(parts)[place].reshape(depth, -1).min(axis=0)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, to size a sketch or the number of exchange groups."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
