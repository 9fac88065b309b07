"""Column functions for numbers, vectors and permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Wichura (1988), algorithm AS 241, coefficients of PPND16, highest power first
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(parts: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    def horner(values: tuple[float, ...]) -> str:
        out = f"{values[0]!r}D"
        for v in values[1:]:
            out = f"({out} * {x} + {v!r}D)"
        return out

    return f"{horner(parts[0])} / {horner(parts[1])}"


def inverse_normal(p: str) -> Column:
    """The inverse of the standard normal distribution function for 0 < p < 1; ``p`` is a column's name."""
    return F.expr(inverse_normal_sql(p, double="D"))


def inverse_normal_sql(p: str, double: str = "") -> str:
    """The same expression as SQL text; ``double`` is the suffix of double literals."""
    q = f"({p} - 0.5D)"
    near = f"(0.180625D - {q} * {q})"
    tail = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    far = f"(CASE WHEN {tail} <= 5 THEN {_ratio(_MIDDLE, f'({tail} - 1.6D)')} ELSE {_ratio(_TAIL, f'({tail} - 5.0D)')} END)"
    text = f"CASE WHEN abs({q}) <= 0.425D THEN {q} * {_ratio(_CENTRE, near)} WHEN {q} < 0 THEN -{far} ELSE {far} END"
    return text if double else "".join(_plain_doubles(text))


def _plain_doubles(text: str) -> list[str]:
    """Double literals as DuckDB reads them: with an exponent, as a bare fraction would be a decimal."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and (text[j].isdigit() or text[j] in ".eE" or (text[j] in "-+" and j > i and text[j - 1] in "eE")):
            j += 1
        if j > i and j < len(text) and text[j] == "D":
            number = text[i:j]
            out.append(number if "e" in number else f"{number}e0")
            i = j + 1
        else:
            j = max(j, i + 1)
            out.append(text[i:j])
            i = j
    return out


def dprime(auroc: str) -> Column:
    """sqrt(2) * inverse normal of an AUROC; censored, without a value, at 1 (right) and 0 (left)."""
    inside = (F.col(auroc) > 0) & (F.col(auroc) < 1)
    value = F.when(inside, F.lit(math.sqrt(2)) * inverse_normal(auroc))
    censoring = F.when(F.col(auroc) >= 1, "right").when(F.col(auroc) <= 0, "left")
    reason = F.when(F.col(auroc) >= 1, "auroc is 1").when(F.col(auroc) <= 0, "auroc is 0")
    return F.struct(value.alias("value"), censoring.alias("censoring"), reason.alias("reason"))


def direction(value: Column, tolerance: float = 1e-15) -> Column:
    return F.when(value.isNull() | (F.abs(value) <= tolerance), "flat").when(value > 0, "increasing").otherwise("decreasing")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pearson(x: Column, y: Column) -> Column:
    """An aggregate: Pearson's correlation, null when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def permutation(number: Column, n: Column | int) -> Column:
    """Permutation ``number`` of 0..n-1 in lexicographic order, as an array: the number's factorial digits pick."""
    n = F.lit(n) if isinstance(n, int) else n
    left = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    state = F.struct(left.alias("left"), F.array().cast("array<int>").alias("out"))
    weights = F.transform(F.reverse(left), lambda i: F.factorial(i))

    def take(s: Column, weight: Column) -> Column:
        i = (F.floor(number / weight) % F.size(s["left"])).cast("int") + 1
        rest = F.concat(F.slice(s["left"], F.lit(1), i - 1), F.slice(s["left"], i + 1, n))
        return F.struct(rest.alias("left"), F.concat(s["out"], F.array(F.element_at(s["left"], i))).alias("out"))

    return F.aggregate(weights, state, take)["out"]


def twice_ranks(values: Column) -> Column:
    """Twice the average ranks of the items of a short array."""
    below = lambda x: F.size(F.filter(values, lambda y: y < x))
    equal = lambda x: F.size(F.filter(values, lambda y: y == x))
    return F.transform(values, lambda x: 2 * below(x) + equal(x) + 1)


def dot_long(a: Column, b: Column) -> Column:
    """The integer inner product of two integer arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
