"""``text.hash_draw`` inside tasks: the MD5 of many short messages at once, in numpy, for draws that are too many to be rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages hashed at once: as many as stay in a core's cache.
LANES = 16384
#: Messages that are sooner hashed one by one.
FEW = 256


def _first_words(words: list[np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of ``n`` messages of one block; a word of the block that all share is a number."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[k]
        if isinstance(word, int):
            np.add(f, np.uint32((word + _SINES[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _decimals(low: int, high: int, width: int) -> np.ndarray:
    """The decimals of low, low + 1, ... below high, all of ``width`` digits, as bytes."""
    left, out = np.arange(low, high, dtype=np.int64), np.empty((high - low, width), np.uint8)
    for k in range(width - 1, -1, -1):
        left, digit = np.divmod(left, 10)
        out[:, k] = digit + 48
    return out


class Draws:
    """``hash_draw(n, *parts, k)`` for all k from 0 below ``n``, for one tuple of parts after another."""

    def __init__(self, n: int) -> None:
        self.n = n
        self._laid: dict[int, list[tuple[int, int, int, list]]] = {}

    def _layout(self, start: int) -> list[tuple[int, int, int, list]]:
        """Lanes (low, high, length of the message, words by number) of counters that begin at byte ``start``."""
        if start not in self._laid:
            lanes, low, width = [], 0, 1
            while low < self.n:
                high = min(self.n, 10**width, low + LANES)
                first, last = start // 4, (start + width) // 4
                own = np.zeros((high - low, 4 * (last - first + 1)), np.uint8)
                at = start - 4 * first
                own[:, at : at + width] = _decimals(low, high, width)
                own[:, at + width] = 128
                lanes.append((low, high, start + width, [(first + k, np.ascontiguousarray(own.view("<u4")[:, k])) for k in range(last - first + 1)]))
                low = high
                width += high == 10**width
            self._laid[start] = lanes
        return self._laid[start]

    def of(self, *parts: object) -> np.ndarray:
        """The n places that are drawn."""
        prefix = "".join(f"{p}|" for p in parts).encode()
        out = np.empty(self.n, np.int64)
        if self.n < FEW or len(prefix) + len(str(self.n)) > 55:  # not worth it, or more than a block
            start = hashlib.md5(prefix)
            for k in range(self.n):
                one = start.copy()
                one.update(str(k).encode())
                out[k] = int(one.hexdigest()[:15], 16) % self.n
            return out
        fixed = np.frombuffer(prefix.ljust(64, b"\0"), "<u4")
        for low, high, length, own in self._layout(len(prefix)):
            words: list[np.ndarray | int] = [int(x) for x in fixed]
            for k, values in own:
                words[k] = values | fixed[k]
            words[14] = 8 * length
            a, b = _first_words(words, high - low)
            # fifteen hexadecimal digits: the first eight bytes without their last four bits
            whole = (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4)).astype(np.uint64)
            out[low:high] = whole % np.uint64(self.n)
        return out
