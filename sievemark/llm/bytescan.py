"""Vectorised byte scanning shared by the text operators.

Every function takes UTF-8 bytes and works on NumPy arrays inside one task. Texts of a batch are handled in
slices of bounded size (``slices``), so a task's memory follows ``SLICE_BYTES`` or its longest single text,
never the partition. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One 64-bit value per byte, drawn from a fixed seed.
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words split at ASCII white space, and of words made of digits, a-z and non-ASCII letters.
SPACE_WORDS = ~_class((0x20, 0x20), (0x09, 0x0D))
LETTER_WORDS = ~_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out[:n]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields (first row, bytes with one space after every text, start of every text and the end). The space
    keeps words and byte windows from reaching into the next text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), n)
        sizes = np.diff(offsets[row : last + 1])
        starts = np.zeros(last - row + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=starts[1:])
        out = np.full(starts[-1], 32, dtype=np.uint8)
        body = data[offsets[row] : offsets[last]]
        keep = np.ones(starts[-1], dtype=bool)
        keep[starts[1:] - 1] = False
        out[keep] = body
        yield row, out, starts
        row = last


def word_bounds(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = is_word[data]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span, from prefix sums of a polynomial modulo 2**64."""
    n = len(data)
    up, down = _POWERS.get(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes_at(words: np.ndarray, places: np.ndarray | slice, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` consecutive word hashes from each of ``places``."""
    up = _powers((_BASE * (2 * salt + 1) + 2 * salt) & ((1 << 64) - 1) | 1, size)
    shifted = (lambda j: words[places.start + j : places.stop + j]) if isinstance(places, slice) else (lambda j: words[places + j])
    out = shifted(0) * up[0]
    for j in range(1, size):
        out += shifted(j) * up[j]
    return mix(out ^ _U(salt * 0x632BE59BD9B4E019 & ((1 << 64) - 1)))


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes."""
    return window_hashes_at(words, slice(0, max(len(words) - size + 1, 0)), size, salt)


def documents_of(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text (by index in the slice) of every byte position."""
    return np.searchsorted(starts, positions, side="right") - 1


def per_document(owner: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each text's run in an ascending array of text indices."""
    return np.searchsorted(owner, np.arange(n + 1))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(values), dtype=np.int64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        reach += step
    return best


def covered(n: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``size`` places from one of ``starts``."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:n]) > 0


def planes(values: np.ndarray) -> bytes:
    """The bytes of a column, lowest ones first: the high ones are mostly zero and compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(coded: bytes, kind: str) -> np.ndarray:
    """The inverse of ``planes`` for a column of type ``kind``."""
    return np.ascontiguousarray(np.frombuffer(coded, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
