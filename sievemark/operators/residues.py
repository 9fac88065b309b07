"""Sums of the lowest coefficients of a product of powers of polynomials, exactly, from residues of many primes.

f = product(g**n) satisfies f' / f = sum(n g' / g), so that each coefficient comes from the last few by small factors.
Modulo a prime this takes a step of a few operations whatever the length of the numbers, and primes know nothing of
each other: a task takes some thousands of them side by side in vectors of doubles, which hold all products exactly.
The residues are put together to the one number below the product of the primes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np

Powers = list[tuple[list[int], int]]

#: Residues are at most 2**25 in size, so that sums of products stay below 2**52.
PRIME_BITS = 26
#: Coefficients worked on at once: lanes of steps, whose inverses are found together.
LANES, STEPS = 4, 64
#: Powers of few blocks are multiplied out while their coefficients have this many bits in all.
LIGHT = 1 << 22


def product(a: list[int], b: list[int]) -> list[int]:
    out = [0] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def recurrence(powers: Powers) -> tuple[list[int], list[int]]:
    """(whole, slope): m whole[0] f[m] is the sum over i of (slope[i-1] - (m - i) whole[i]) f[m - i]."""
    whole = [1]
    for g, _ in powers:
        whole = product(whole, g)
    slope = [0] * (len(whole) - 1)
    for i, (g, n) in enumerate(powers):
        part = [n * k * x for k, x in enumerate(g)][1:] or [0]
        for j, (other, _) in enumerate(powers):
            part = product(part, other) if j != i else part
        slope = [a + b for a, b in itertools.zip_longest(slope, part, fillvalue=0)]
    return whole, slope


def _expanded(powers: Powers) -> list[int]:
    """All coefficients of the product, as digits of its value at a power of 256."""
    size = 1 + sum(n * (len(g) - 1) for g, n in powers)
    width = math.prod(sum(g) ** n for g, n in powers).bit_length() // 8 + 1
    value = math.prod(sum(x << 8 * width * k for k, x in enumerate(g)) ** n for g, n in powers)
    told = value.to_bytes(width * size, "little")
    return [int.from_bytes(told[k : k + width], "little") for k in range(0, len(told), width)]


def _split(powers: Powers) -> tuple[Powers, Powers]:
    """Powers for the recurrence and those to multiply out: a recurrence gets longer with each polynomial."""
    heavy, light, size, bits = sorted(powers, key=lambda p: p[1] * (len(p[0]) - 1)), [], 1, 1
    while len(heavy) > 1:
        g, n = heavy[0]
        size, bits = size + n * (len(g) - 1), bits + n * sum(g).bit_length()
        if size * bits > LIGHT:
            break
        light.append(heavy.pop(0))
    return heavy, light


def primes(bits: int, needed: int) -> np.ndarray:
    """The largest primes below 2**bits, as many as have a product of over 2**needed."""
    small = np.ones(1 << (bits + 1) // 2, bool)
    small[:2] = False
    for k in range(2, math.isqrt(len(small)) + 1):
        if small[k]:
            small[k * k :: k] = False
    found, have, end = [], 0.0, 1 << bits
    while have < needed + 1:
        start = end - (1 << 20)
        if start < 1 << bits - 1:
            raise ValueError("too few primes of this size")
        left = np.ones(end - start, bool)
        for k in np.flatnonzero(small).tolist():
            left[-start % k :: k] = False
        part = (start + np.flatnonzero(left))[::-1]
        sums = have + np.cumsum(np.log2(part))
        found.append(part[: int(np.searchsorted(sums, needed + 1)) + 1])
        have, end = float(sums[-1]), start
    return np.concatenate(found)


class Sum:
    """The sum of the ``many`` lowest coefficients of the product of powers, modulo primes of ``bits`` bits.

    Heavy powers go through the recurrence, in steps of their own; the coefficients of the others weigh its last terms.
    """

    def __init__(self, powers: Powers, many: int):
        self.constants = [(g[0], n) for g, n in powers if len(g) == 1]
        heavy, light = _split([(g, n) for g, n in powers if len(g) > 1])
        self.pace = math.gcd(*(k for g, _ in heavy for k, x in enumerate(g) if x)) or 1
        self.heavy = [(g[:: self.pace], n) for g, n in heavy]
        self.weights = list(itertools.accumulate(_expanded(light)))
        self.many = many
        self.terms = -(-many // self.pace)
        whole, slope = recurrence(self.heavy)
        self.first = whole[0]
        self.order = len(whole) - 1
        self.rows = [[s + i * w for i, (s, w) in enumerate(zip(slope, whole[1:], strict=True), 1)], whole[1:]]
        ends = max((sum(abs(s - m * w) for s, w in zip(*self.rows, strict=True)) for m in (0, self.terms + LANES * STEPS)), default=0)
        self.needed = math.prod(sum(g) ** n for g, n in powers).bit_length() + 1
        # a factor times a residue is summed in one go where that is exact, if need be for smaller primes; else in digits
        for self.bits in range(PRIME_BITS, PRIME_BITS - 4, -1):
            room = (1 << self.bits - 1) / (self.bits * 0.7) * (self.bits - 1) > self.needed * 1.1
            if ends << self.bits - 1 <= 1 << 52 and self.terms + LANES * STEPS < 1 << self.bits - 1 and room:
                self.digits = 0
                return
        self.bits, self.digits = PRIME_BITS, min(26, 28 - self.order.bit_length())

    @property
    def fits(self) -> bool:
        return self.order > 0 and self.terms + LANES * STEPS < 1 << self.bits - 1

    def primes(self) -> np.ndarray:
        return primes(self.bits, self.needed)

    def _factors(self) -> Callable[[np.ndarray], np.ndarray]:
        """Factors of the last terms, by the places that these have in a ring, for numbers m of terms."""
        rows = [np.array([0, *row], float) for row in self.rows]

        def of(m: np.ndarray) -> np.ndarray:
            back = (m[:, None] - np.arange(self.order) - 1) % self.order + 1
            return rows[0][back] - m[:, None] * rows[1][back]

        return of

    def _digit_rows(self) -> list[np.ndarray]:
        """For both rows their digits, the highest first, each between plus and minus half of their base."""
        base, out = 1 << self.digits, []
        for row in self.rows:
            digits = []
            while any(row):
                low = [(x + base // 2) % base - base // 2 for x in row]
                row = [(x - y) // base for x, y in zip(row, low, strict=True)]
                digits.append([0, *low])
            out.append(np.array(digits[::-1], float))
        return out

    def modulo(self, p: np.ndarray) -> np.ndarray:
        """The sum modulo each of the primes."""
        p = p.astype(float)
        inverse, spare = 1 / p, np.empty((LANES, len(p)))

        def reduce(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
            q = spare if x.ndim == 2 else spare[0]
            np.multiply(x, inverse, q)
            np.rint(q, q)
            np.multiply(q, p, q)
            return np.subtract(x, q, x if out is None else out)

        def constants(x: int) -> np.ndarray:
            return reduce(np.array([x % int(k) for k in p], float))

        exponent = [(p.astype(np.int64) - 2) >> k & 1 == 1 for k in range(self.bits - 1, -1, -1)]

        def inverted(x: np.ndarray) -> np.ndarray:
            out = np.ones(len(p))
            for bit in exponent:
                out = reduce(out * out)
                out = reduce(out * np.where(bit, x, 1.0))
            return out

        d, ring, value = self.order, np.zeros((self.order, len(p))), np.empty(len(p))
        lowest = self.constants + [(g[0], n) for g, n in self.heavy]
        ring[0] = reduce(np.array([math.prod(pow(x, n, int(k)) for x, n in lowest) % int(k) for k in p], float))
        if not self.digits:
            factors = self._factors()
        else:
            high, low = self._digit_rows()
            stacked = np.concatenate([high, low])
            turns = [np.ascontiguousarray(stacked[:, (k - np.arange(d) - 1) % d + 1]) for k in range(d)]
            sums = np.empty((len(stacked), len(p)))

            def joined(rows: np.ndarray) -> np.ndarray:
                x = rows[0]
                for y in rows[1:]:
                    np.add(np.multiply(reduce(x), 1 << self.digits, x), y, x)
                return reduce(x)
        first = inverted(constants(self.first)) if self.first != 1 else None
        last = self.many - len(self.weights)  # up to this place of the whole product a term counts by the whole of the weights
        whole, edge = np.zeros(len(p)), np.zeros(len(p))
        limbs = -(-self.weights[-1].bit_length() // 16) or 1
        bases = np.stack([constants(1 << 16 * k) for k in range(limbs)])

        def weighed(start: int, stop: int) -> np.ndarray:
            own = b"".join(self.weights[self.many - 1 - self.pace * k].to_bytes(2 * limbs, "little") for k in range(start, stop))
            out = np.frombuffer(own, "<u2").reshape(-1, limbs).astype(float) @ bases
            return np.stack([reduce(x) for x in out])

        def add(k: int, x: np.ndarray, table: np.ndarray | None, at: int) -> None:
            if self.pace * k <= last:
                np.add(whole, x, whole)
            else:
                np.add(edge, reduce(x * table[k - at]), edge)

        start = max(0, last // self.pace + 1)  # the first term of the edge
        add(0, ring[0], weighed(0, 1) if start == 0 else None, 0)
        products = np.empty((STEPS, LANES, len(p)))
        for begin in range(1, self.terms, LANES * STEPS):
            stop = min(begin + LANES * STEPS, self.terms)
            m = begin + np.arange(LANES, dtype=float)[:, None] * STEPS
            # inverses of begin + STEPS * lane + step, by products up to them
            products[0] = m
            for k in range(1, STEPS):
                reduce(np.multiply(products[k - 1], m + k, products[k]))
            ends = products[-1].copy()
            after = [np.ones(len(p))]
            for k in range(LANES - 1, 0, -1):
                after.append(reduce(after[-1] * ends[k]))
            running = inverted(reduce(after[-1] * ends[0]))
            for k in range(LANES):  # running is the inverse of the products of lane k and those after it
                ahead = after[LANES - 1 - k]
                own = reduce(running * ahead)
                running = reduce(running * ends[k])
                ends[k] = own
            for k in range(STEPS - 1, 0, -1):
                reduce(np.multiply(ends, products[k - 1], products[k]))
                reduce(np.multiply(ends, m + k, ends))
            products[0] = ends
            table = weighed(max(begin, start), stop) if stop > start else None
            if not self.digits:
                own = factors(np.arange(begin, stop))
            for at in range(begin, stop):
                lane, step = divmod(at - begin, STEPS)
                if not self.digits:
                    np.dot(own[at - begin], ring, value)
                else:
                    np.dot(turns[at % d], ring, sums)
                    above, below = joined(sums[: len(high)]), joined(sums[len(high) :])
                    np.subtract(above, np.multiply(below, at, below), value)
                reduce(value)
                np.multiply(value, products[step, lane], value)
                if first is not None:
                    np.multiply(reduce(value), first, value)
                term = reduce(value, ring[at % d])
                add(at, term, table, max(begin, start))
            reduce(whole), reduce(edge)
        total = reduce(reduce(whole * constants(self.weights[-1])) + edge)
        return total.astype(np.int64) % p.astype(np.int64)


def _joined(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """Sum of numerators over the other denominators, as of fractions, and the product of the denominators."""
    while len(pairs) > 1:
        even = [(a * q + b * p, p * q) for (a, p), (b, q) in zip(pairs[::2], pairs[1::2])]  # noqa: B905
        pairs = even + pairs[len(even) * 2 :]
    return pairs[0]


def share(summed: Sum, part: int, parts: int) -> tuple[int, int]:
    """What part ``part`` of the primes knows: a numerator over the product of its primes."""
    every = summed.primes()
    own = every[part::parts]
    found = summed.modulo(own)
    held = [int(k) for k in own]
    mine = _joined([(0, k) for k in held])[1]
    others = _joined([(0, int(k)) for k in every])[1] // mine % mine
    return _joined([(int(x) * pow(mine // k % k * (others % k), -1, k) % k, k) for x, k in zip(found, held, strict=True)])


def whole(shares: list[tuple[int, int]]) -> int:
    """The number that all parts of the primes tell together."""
    above, below = _joined(shares)
    return above % below
