"""Page's trend test over blocks: statistic, exact tail, and the audit of ceiling columns.

Blocks are rows (suite, block, column number from 1, value). The statistic is the sum over blocks of column number
times rank in the block. Its exact distribution under k!^B equally likely arrangements is a convolution of the
blocks' own distributions; blocks with equal sets of ranks have equal ones, so blocks are first counted by
pattern (few patterns whatever the number of blocks). As a polynomial the whole distribution is a product of few
powers g**n, and f = product(g**n) satisfies f' / f = sum(n g' / g): this gives each coefficient from the last few
ones by small factors, so the tail is summed in exact integers while only those few are held. Numerator and
denominator have hundreds of digits and are given as text. A long tail is counted modulo many primes, which are dealt
to tasks (``residues``). Where only p is asked for, it comes from a finite Fourier sum in fixed point with a bound on its
error, of which only a few terms count, and is the double nearest to the exact ratio.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, deque
from decimal import MAX_EMAX, MAX_PREC, MIN_EMIN, Context, Decimal, Inexact, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import permutation, twice_ranks
from . import residues


#: Up to this many values times bits a distribution is summed in exact integers even where only p is asked for.
SHORT = 1 << 22


#: From this many coefficients times bits on, a tail is counted modulo primes, by many tasks.
LONG = 1 << 30
#: Primes that a task takes, at least and at most.
FEW, MANY = 256, 4096


def patterns(df: DataFrame, suite: list[str], block: str, column: str, value: str | Column) -> DataFrame:
    """suite, doubled ranks by column, and how many blocks have them."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.groupBy(*suite, block).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), value.alias("v")))), lambda x: x["v"]).alias("_v"))
    return rows.select(*suite, twice_ranks(F.col("_v")).alias("ranks")).groupBy(*suite, "ranks").agg(F.count(F.lit(1)).alias("blocks"))


def statistic(counted: DataFrame, suite: list[str]) -> DataFrame:
    """suite, blocks, columns, twice L, the null mean B k (k + 1)**2 / 4 and the direction from it."""
    own = F.aggregate(F.transform("ranks", lambda r, i: r.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    out = counted.groupBy(*suite).agg(F.sum("blocks").alias("blocks"), F.max(F.size("ranks")).alias("columns"), F.sum(own * F.col("blocks")).alias("twice_l"))
    out = out.withColumn("null_mean", F.col("blocks") * F.col("columns") * (F.col("columns") + 1) * (F.col("columns") + 1) / 4)
    gap = F.col("twice_l") / 2 - F.col("null_mean")
    return out.withColumn("direction", F.when(gap == 0, "flat").when(gap > 0, "increasing").otherwise("decreasing"))


def block_outcomes(ranks: tuple[int, ...]) -> Counter[int]:
    """How many of the k! arrangements of a block give each value of twice its statistic."""
    return Counter(sum(j * r for j, r in enumerate(p, 1)) for p in itertools.permutations(ranks))


def _first_coefficients(powers: list[tuple[list[int], int]], many: int) -> int:
    """The sum of the ``many`` lowest coefficients of the product of the powers (polynomial, exponent)."""
    whole, slope = residues.recurrence(powers)
    lowest = math.prod(g[0] ** n for g, n in powers)
    recent = deque([lowest], maxlen=len(whole))  # the last coefficients, the newest first
    total = lowest if many > 0 else 0
    for m in range(1, many):
        # m whole[0] f[m] = sum over i of (slope[i-1] - (m - i) whole[i]) f[m - i]
        value = sum((slope[i] - (m - i - 1) * (whole[i + 1] if i + 1 < len(whole) else 0)) * f for i, f in enumerate(recent) if i < len(slope))
        value //= m * whole[0]
        recent.appendleft(value)
        total += value
    return total


def _tail_parts(counted: dict[tuple[int, ...], int]) -> tuple[list[tuple[list[int], int]], int, int, int]:
    """Powers whose product is the distribution, how many of its values are not below the observed one and how many are, all arrangements."""
    observed = sum(n * sum(j * r for j, r in enumerate(ranks, 1)) for ranks, n in counted.items())
    alike: Counter[tuple[int, ...]] = Counter()
    for ranks, n in counted.items():
        alike[tuple(sorted(ranks))] += n
    outcomes = [(block_outcomes(ranks), n) for ranks, n in sorted(alike.items())]
    total = math.prod(sum(o.values()) ** n for o, n in outcomes)
    step = math.gcd(*(x - min(o) for o, _ in outcomes for x in o)) or 1
    powers = [([o.get(x, 0) for x in range(min(o), max(o) + 1, step)], n) for o, n in outcomes]
    highest = sum(n * max(o) for o, n in outcomes)
    lowest = sum(n * min(o) for o, n in outcomes)
    return powers, (highest - observed) // step + 1, (observed - lowest) // step, total


def tail(counted: dict[tuple[int, ...], int]) -> tuple[int, int]:
    """Arrangements with at least the observed statistic, and all arrangements."""
    powers, many, upper, total = _shorter_side(counted)
    own = _first_coefficients(powers, many)
    return own if upper else total - own, total


def _shorter_side(counted: dict[tuple[int, ...], int]) -> tuple[list[tuple[list[int], int]], int, bool, int]:
    """Powers and how many of their lowest coefficients to sum, whether this is the tail or what it leaves, all arrangements."""
    powers, above, below, total = _tail_parts(counted)
    if above <= below:
        return [(g[::-1], n) for g, n in powers], above, True, total
    return powers, below, False, total


def _shared(counted: dict[tuple[int, ...], int], long: int) -> residues.Sum | None:
    """The sum to be counted modulo primes, where it is long."""
    powers, many, _, total = _shorter_side(counted)
    if many * total.bit_length() < long:
        return None
    found = residues.Sum(powers, many)
    return found if found.fits else None


def _turn(n: int, bits: int) -> tuple[int, int]:
    """Cosine and sine of pi / n, times 2**bits, to within four units."""
    spare = bits + 32

    def arctan(x: int) -> int:  # of 1 / x
        power = total = (1 << spare) // x
        for k in itertools.count(3, 2):
            power //= -x * x
            if -1 <= power <= 0:
                return total
            total += power // k

    angle = 4 * (4 * arctan(5) - arctan(239)) // n
    sums, term = [0, 0], 1 << spare
    for k in itertools.count(1):
        sums[(k - 1) % 2] += -term if (k - 1) // 2 % 2 else term
        term = (term * angle >> spare) // k
        if not term:
            return sums[0] >> 32, sums[1] >> 32


def _probability(powers: list[tuple[list[int], int]], many: int, bits: int) -> tuple[int, int]:
    """Bounds, times 2**(bits + 1), on the share of the ``many`` lowest coefficients in the product of palindromic powers.

    With D its degree, N = D + 1 and t = 2 pi k / N the share is many / N plus the sum over 0 < k < N / 2 of
    (-1)**k psi(t) sin(many t) / (N sin(t / 2)), where psi is the product of (sum of g[j] cos((j - d / 2) t) / g(1))**n.
    Away from few k, psi is below any bound that counts; those are found in doubles and left out, the others are
    calculated in fixed point. Table entries are out by 16 N units at most, psi by 64 N times the exponents, and
    sin(t / 2) is 2 k / N at least, so that the spare digits keep the whole error below 2**-bits.
    """
    size = 1 + sum(n * (len(g) - 1) for g, n in powers)
    spare = 2 * size.bit_length() + sum(n for _, n in powers).bit_length() + 16
    scale = bits + spare
    root = 1 << ((2 * size).bit_length() + 1) // 2

    def times(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        return (a[0] * b[0] - a[1] * b[1]) >> scale, (a[0] * b[1] + a[1] * b[0]) >> scale

    fine, coarse = [(1 << scale, 0), _turn(size, scale)], [(1 << scale, 0)]
    while len(fine) <= root:
        fine.append(times(fine[-1], fine[1]))
    while len(coarse) * root < 2 * size:
        coarse.append(times(coarse[-1], fine[root]))

    def turned(k: int) -> tuple[int, int]:  # cosine and sine of pi k / N
        k %= 2 * size
        return times(coarse[k // root], fine[k % root])

    def psi(k: int) -> int:
        whole = 1 << scale
        for g, n in powers:
            d = len(g) - 1
            part = sum(2 * g[j] * turned((d - 2 * j) * k)[0] for j in range((d + 1) // 2)) + (g[d // 2] << scale if d % 2 == 0 else 0)
            part //= sum(g)
            raised = 1 << scale
            for bit in bin(n)[2:]:
                raised = raised * raised >> scale
                raised = raised * part >> scale if bit == "1" else raised
            whole = whole * raised >> scale
        return whole

    total = 0
    for start in range(1, (size + 1) // 2, 1 << 18):
        k = np.arange(start, min(start + (1 << 18), (size + 1) // 2))
        logs = np.zeros(len(k))
        for g, n in powers:
            d = len(g) - 1
            # whole multiples of pi / N are reduced before they are rounded
            part = sum(2 * g[j] * np.cos((d - 2 * j) * k % (2 * size) * (math.pi / size)) for j in range((d + 1) // 2)) + (g[d // 2] if d % 2 == 0 else 0)
            logs += n * np.log2(np.minimum(1.0, np.abs(part) / sum(g) + 1e-11))
        for i in k[logs > -bits - 8].tolist():
            term = psi(i) * turned(2 * many * i)[1] // turned(i)[1]
            total += -term if i % 2 else term
    share = (((many << scale) + total) << 1) // size >> spare
    return share - 4, share + 4


def nearest_p(counted: dict[tuple[int, ...], int]) -> float:
    """The double nearest to the first over the second number of ``tail``, without their digits.

    A block's outcomes are symmetric, as columns can be reversed: as many values as are not below the observed one
    have the same share from the lowest up.
    """
    powers, above, _, total = _tail_parts(counted)
    if sum(n * len(g) for g, n in powers) * total.bit_length() > SHORT:
        for bits in (128, 256, 1280):
            low, high = (max(x, 0) / (1 << bits + 1) for x in _probability(powers, above, bits))
            if low == high:
                return low
    arrangements, total = tail(counted)
    return arrangements / total


def decimal_text(x: int) -> str:
    """A whole number of any length in decimal; Python's own conversion refuses more than 4,300 digits."""
    with localcontext(Context(prec=MAX_PREC, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[Inexact])):
        return _decimal(x).to_eng_string() if abs(x) >= 1 << 4096 else str(x)


def _decimal(x: int) -> Decimal:
    """``x`` from halves of its bits, so that the work is that of a few long products."""
    if x < 0:
        return -_decimal(-x)
    bits = x.bit_length()
    if bits <= 4096:
        return Decimal(x)
    half = bits // 2
    return _decimal(x >> half) * Decimal(2) ** half + _decimal(x & ((1 << half) - 1))


def exact_test(df: DataFrame, suite: list[str], block: str, column: str, value: str | Column) -> DataFrame:
    """``statistic`` with numerator, denominator (text) and p of the one-sided exact tail."""
    counted = patterns(df, suite, block, column, value)
    slots = df.sparkSession.sparkContext.defaultParallelism
    long, least, most = LONG, FEW, MANY

    # Spark reads hints of these as kinds of vectors, so they have none
    def of(rows):
        return {tuple(map(int, r["ranks"])): int(r["blocks"]) for r in rows}

    def parts(rows):
        summed = _shared(of(rows), long)
        many = len(summed.primes()) if summed else 0
        return min(slots * -(-many // (slots * most)), -(-many // least)) or 1

    def share(rows, part, parts):
        if parts == 1:
            return b"", b""
        return tuple(x.to_bytes(x.bit_length() // 8 + 1, "little") for x in residues.share(_shared(of(rows), long), part, parts))

    def told(rows, shares):
        if len(shares) > 1:
            _, _, upper, total = _shorter_side(of(rows))
            own = residues.whole([(int.from_bytes(r["above"], "little"), int.from_bytes(r["below"], "little")) for r in shares])
            above = own if upper else total - own
        else:
            above, total = tail(of(rows))
        return decimal_text(above), decimal_text(total), above / total

    # a suite's patterns are a row, which goes to as many tasks as its primes need
    held = counted.groupBy(*suite).agg(F.collect_list(F.struct("ranks", "blocks")).alias("counted"))
    each = held.withColumn("parts", F.udf(parts, "int").asNondeterministic()("counted")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shares = each.repartition(8 * slots).withColumn("share", F.udf(share, "struct<above: binary, below: binary>").asNondeterministic()("counted", "part", "parts"))
    known = shares.groupBy(*suite).agg(F.first("counted").alias("counted"), F.collect_list("share").alias("shares"))
    fold = F.udf(told, "struct<numerator: string, denominator: string, p: double>").asNondeterministic()
    return statistic(counted, suite).join(known.select(*suite, fold("counted", "shares").alias("told")).select(*suite, "told.*"), suite)


def p_test(df: DataFrame, suite: list[str], block: str, column: str, value: str | Column) -> DataFrame:
    """``statistic`` with p of the one-sided exact tail, the same as ``exact_test``'s, whose numbers it doesn't need."""
    counted = patterns(df, suite, block, column, value)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema.fields if f.name in suite)

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = nearest_p({tuple(map(int, r)): int(n) for r, n in zip(rows["ranks"], rows["blocks"], strict=True)})
        return pd.DataFrame([[*key, p]], columns=[*suite, "p"])

    return statistic(counted, suite).join(counted.groupBy(*suite).applyInPandas(fold, f"{fields}, p double"), suite)


def verdict(tests: DataFrame, audits: DataFrame, suite: str, alpha: float = 0.05) -> DataFrame:
    """suite and its label: withheld, or supported where all hidden orders (or the only one) increase with p below alpha."""
    plain = (F.col("direction") == "increasing") & (F.col("p") < alpha)
    robust = (F.col("directions") == "increasing") & (F.col("decisions") == "true")
    met = tests.select(suite, "direction", "p").join(audits.select(suite, "audit", "directions", "decisions"), suite)
    # fixed values: labels of the panel
    named = F.when(F.col("audit") == "WITHHELD", "WITHHELD_CEILING").when(F.when(F.col("audit") == "ROBUST", robust).otherwise(plain), "DIRECTIONAL_SUPPORTED").otherwise("DIRECTIONAL_NOT_SUPPORTED")
    return met.select(suite, named.alias("verdict"))


def ceiling_audit(df: DataFrame, suite: str, block: str, column: str, value: str, ceiling: str, alpha: float = 0.05) -> DataFrame:
    """One row per suite: ranges of L and p over the hidden orders of ceiling columns.

    ``ceiling`` marks columns whose AUROC is 1; with two or more, each hidden order puts 1 + its rank in every block.
    """
    tops = df.where(ceiling).groupBy(suite).agg(F.array_sort(F.collect_set(column)).alias("tops"))
    rows = df.join(F.broadcast(tops), suite, "left").withColumn("tops", F.coalesce("tops", F.array().cast(tops.schema["tops"].dataType)))
    orders = F.when(F.size("tops") >= 2, F.factorial(F.size("tops"))).otherwise(F.lit(1).cast("long"))
    rows = rows.withColumn("order", F.explode(F.sequence(F.lit(0).cast("long"), orders - 1)))
    hidden = F.element_at(permutation(F.col("order"), F.size("tops")), F.array_position("tops", F.col(column)).cast("int"))
    changed = F.when(F.col(ceiling) & (F.size("tops") >= 2), 1.0 + 1 + hidden).otherwise(F.col(value))
    each = p_test(rows.withColumn("_value", changed), [suite, "order"], block, column, "_value")
    out = each.withColumn("supported", (F.col("p") < alpha) & (F.col("direction") == "increasing")).groupBy(suite)
    out = out.agg(
        F.count(F.lit(1)).alias("orders"),
        (F.min("twice_l") / 2).alias("l_low"),
        (F.max("twice_l") / 2).alias("l_high"),
        F.min("p").alias("p_low"),
        F.max("p").alias("p_high"),
        F.array_join(F.array_sort(F.collect_set("direction")), ",").alias("directions"),
        F.array_join(F.array_sort(F.collect_set(F.col("supported").cast("string"))), ",").alias("decisions"),
    )
    varies = F.col("directions").contains(",") | F.col("decisions").contains(",")
    return out.withColumn("audit", F.when(F.col("orders") == 1, "NO_AMBIGUOUS").when(varies, "WITHHELD").otherwise("ROBUST"))
