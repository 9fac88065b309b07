"""Statistics against published values, brute force on small inputs, and invariants."""

from __future__ import annotations

import itertools
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from sievemark.functions.numeric import dprime, inverse_normal, permutation
from sievemark.operators import additive, auroc, bootstrap, cluster, page, qap, ranking, spearman

SCALE = [("70m", 70e6), ("410m", 410e6), ("1.4b", 1.4e9), ("2.8b", 2.8e9), ("6.9b", 6.9e9)]
AT_64 = [0.9996795385354911, 0.9995193078032366, 1.0, 1.0, 0.9996795385354911]
AT_32 = [0.9945521551033488, 0.9690754686748918, 0.9708380067296908, 0.9822143887197564, 0.9786893126101587]


def brute_ranks(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


def brute_rho(x, y):
    a, b = brute_ranks(x), brute_ranks(y)
    m, n = sum(a) / len(a), sum(b) / len(b)
    spread = math.sqrt(sum((p - m) ** 2 for p in a) * sum((q - n) ** 2 for q in b))
    return sum((p - m) * (q - n) for p, q in zip(a, b, strict=True)) / spread if spread else None


def test_dprime_published_values(spark):
    df = spark.createDataFrame([(0.9937510014420766, 3.53236929855913), (0.9998397692677455, 5.088583877702719), (0.9690754686748918, 2.6408688328289056)], "a double, d double")
    for r in df.select(dprime("a").alias("x"), "d").collect():
        assert math.isclose(r.x.value, r.d, rel_tol=1e-12) and r.x.censoring is None
    ends = [r.x for r in spark.createDataFrame([(1.0,), (0.0,)], "a double").select(dprime("a").alias("x")).collect()]
    assert [(e.value, e.censoring) for e in ends] == [(None, "right"), (None, "left")]


def test_inverse_normal_everywhere(spark):
    points = [k / 1000 for k in range(1, 1000)] + [1e-10, 1e-30, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in points], "p double").select("p", inverse_normal("p").alias("z"))
    assert all(math.isclose(r.z, NormalDist().inv_cdf(r.p), rel_tol=1e-12, abs_tol=1e-14) for r in df.collect())


def suite(spark, name, values):
    return spark.createDataFrame([(name, math.log10(p), v, v == 1.0) for (_, p), v in zip(SCALE, values, strict=True)], "suite string, x double, y double, top boolean")


def test_spearman_published_values(spark):
    rows = suite(spark, "64", AT_64).union(suite(spark, "32", AT_32))
    got = {r.suite: r for r in spearman.exact_test(rows, "suite", "x", "y", 5, "greater").collect()}
    less = {r.suite: r for r in spearman.exact_test(rows, "suite", "x", "y", 5).collect()}
    assert math.isclose(less["64"].rho, 0.3689323936863109, rel_tol=1e-12) and less["64"]["count"] == 92 and less["64"].total == 120
    assert math.isclose(less["32"].rho, -0.1, rel_tol=1e-12) and less["32"]["count"] == 57
    assert got["32"].direction == "decreasing" and got["32"]["count"] + less["32"]["count"] >= 120
    audit = {r.suite: r for r in spearman.ceiling_audit(rows, "suite", "x", "y", "top", 5).collect()}
    assert audit["32"].audit == "NO_AMBIGUOUS" and audit["64"].audit == "ROBUST" and audit["64"].orders == 2
    assert math.isclose(audit["64"].rho_low, 0.30779350562554625, rel_tol=1e-12) and math.isclose(audit["64"].rho_high, 0.41039134083406165, rel_tol=1e-12)
    assert (audit["64"].p_low, audit["64"].p_high) == (82 / 120, 94 / 120)


def test_spearman_brute_force(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for s in range(6):
        y = [rng.choice((0.1, 0.2, 0.3, 0.4)) for _ in range(4)] if s else [1.0] * 4
        rows += [(s, i, v) for i, v in enumerate(y)]
        rho = brute_rho(range(4), y)
        every = [brute_rho(range(4), p) for p in itertools.permutations(y)]
        expected[s] = (rho, sum(v <= rho + 1e-12 for v in every) if rho is not None else 24)
    for r in spearman.exact_test(spark.createDataFrame(rows, "s int, x int, y double"), "s", "x", "y", 4).collect():
        rho, count = expected[r.s]
        assert r["count"] == count and (r.rho is None) == (rho is None) and (rho is None or math.isclose(r.rho, rho, abs_tol=1e-12))


def test_permutations_are_lexicographic(spark):
    got = [tuple(r.p) for r in spark.range(120).select(permutation(F.col("id"), 5).alias("p"), "id").orderBy("id").collect()]
    assert got == list(itertools.permutations(range(5)))
    assert [r.p for r in spark.range(1).select(permutation(F.col("id"), 0).alias("p")).collect()] == [[]]


@pytest.mark.parametrize("kind", ["mixed", "tied", "split", "inverted"])
def test_auroc_and_contributions(spark, kind):
    rng = random.Random(2)
    make = {"mixed": lambda: (rng.randint(0, 9), rng.randint(0, 12)), "tied": lambda: (1, 1), "split": lambda: (rng.random(), 2 + rng.random()), "inverted": lambda: (3 + rng.random(), rng.random())}[kind]
    rows = [("c", i, *map(float, make())) for i in range(40)] + [("d", 1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "cell string, source int, human double, generated double")
    kernel = lambda a, h: 1.0 if a > h else 0.5 if a == h else 0.0
    own = [r for r in rows if r[0] == "c"]
    mean = sum(kernel(x[3], y[2]) for x in own for y in own) / 1600
    got = {r.cell: r for r in auroc.auroc(df).collect()}
    assert got["c"].auroc == mean and got["c"].ceiling == (mean == 1.0) and got["d"].ceiling
    q = {r.source: r.contribution for r in auroc.contributions(df).where("cell = 'c'").collect()}
    assert math.isclose(sum(q.values()) / 40, mean, abs_tol=1e-12)
    for _, i, human, made in own:
        expected = (sum(kernel(made, y[2]) for y in own) + sum(kernel(x[3], human) for x in own)) / 80
        assert math.isclose(q[i], expected, abs_tol=1e-12)


def test_running_total_over_ranges(spark):
    rows = [(g, v, 1 + v % 3) for g in "ab" for v in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    got = ranking.running_total(df, ["g"], "v", {"below": F.col("n")}, ranges=7).collect()
    assert all(r.below == sum(1 + k % 3 for k in range(r.v)) for r in got) and len(got) == 1000


def test_page_exact_tail(spark):
    rng = random.Random(3)
    for k, b in ((3, 4), (4, 2), (2, 5)):
        table = [[rng.choice((1.0, 2.0, 3.0)) for _ in range(k)] for _ in range(b)]
        rows = [("s", i, j, v) for i, block in enumerate(table) for j, v in enumerate(block, 1)]
        r = page.exact_test(spark.createDataFrame(rows, "suite string, block int, col int, v double"), ["suite"], "block", "col", "v").first()
        stat = lambda t: sum(j * x for row in t for j, x in enumerate(brute_ranks(row), 1))
        every = [stat(t) for t in itertools.product(*(list(itertools.permutations(row)) for row in table))]
        seen = stat(table)
        assert r.twice_l == 2 * seen and int(r.denominator) == math.factorial(k) ** b == len(every)
        assert int(r.numerator) == sum(v >= seen - 1e-9 for v in every)
        assert math.isclose(r.null_mean, b * k * (k + 1) ** 2 / 4)
    strong = [("s", i, j, float(j)) for i in range(79) for j in range(1, 5)]
    r = page.exact_test(spark.createDataFrame(strong, "suite string, block int, col int, v double"), ["suite"], "block", "col", "v").first()
    assert r.null_mean == 1975.0 and r.numerator == "1" and int(r.denominator) == 24**79


def test_page_ceiling_audit(spark):
    rows = [("s", i, j, float(j), j >= 3) for i in range(6) for j in range(1, 5)]
    df = spark.createDataFrame(rows, "suite string, block int, col int, v double, top boolean")
    r = page.ceiling_audit(df, "suite", "block", "col", "v", "top").first()
    assert r.orders == 2 and r.l_high > r.l_low and r.audit == "ROBUST"
    assert page.ceiling_audit(df.withColumn("top", F.col("col") == 4), "suite", "block", "col", "v", "top").first().audit == "NO_AMBIGUOUS"


def test_bootstrap_weights_and_labels(spark):
    rows = [("a", i, float(i % 5), float(i % 7)) for i in range(12)] + [("b", i, float(i % 4), float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "cell string, source int, human double, generated double")
    drawn = bootstrap.draws(spark, 20, 12, 7).collect()
    assert {(r.rep, r.draw) for r in drawn} == {(a, b) for a in range(20) for b in range(12)}
    got = {(r.rep, r.cell): r.auroc for r in bootstrap.samples(df, 20, 7).collect()}
    for rep in range(20):
        places = [r.place for r in drawn if r.rep == rep]
        for cell in "ab":
            own = {r[1]: r for r in rows if r[0] == cell}
            mean = sum(1.0 if own[i][3] > own[j][2] else 0.5 if own[i][3] == own[j][2] else 0.0 for i in places for j in places) / 144
            assert math.isclose(got[rep, cell], mean, abs_tol=1e-12)
    cases = [((0.1, 0.2, [False] * 4), "DISSOCIATION_RW_MORE_DETECTABLE"), ((-0.3, -0.1, [False] * 4), "DISSOCIATION_RW_LESS_DETECTABLE"), ((-0.1, 0.1, [False] * 4), "NO_DISSOCIATION"), ((0.1, 0.2, [True, False, False, True]), "CEILING_CENSORED"), ((0.1, 0.2, [False, False, True, True]), "WITHHELD_CEILING")]
    for (low, high, tops), label in cases:
        assert spark.range(1).select(bootstrap.decision(F.lit(0.0), F.lit(low), F.lit(high), [F.lit(t) for t in tops])).first()[0] == label


@pytest.mark.parametrize("which", ["upper", "ordered"])
def test_qap_brute_force(spark, which):
    rng = random.Random(5)
    n = 5
    p = {(i, j): rng.randint(0, 6) / 7 for i in range(n) for j in range(n) if i < j}
    t = {(i, j): rng.randint(0, 6) / 7 for i in range(n) for j in range(n) if i < j}
    full = [(i, j, p[min(i, j), max(i, j)], t[min(i, j), max(i, j)]) for i in range(n) for j in range(n) if i != j]
    r = qap.qap_exact(spark.createDataFrame(full, "i int, j int, predictor double, target double"), n, which).first()
    pairs = [(i, j) for i in range(n) for j in range(n) if (i < j if which == "upper" else i != j)]
    value = lambda m, i, j: m[min(i, j), max(i, j)]
    target = [value(t, *x) for x in pairs]
    every = [brute_rho([value(p, s[i], s[j]) for i, j in pairs], target) for s in itertools.permutations(range(n))]
    assert math.isclose(r.rho, every[0], abs_tol=1e-9) and r.total == 120
    assert r["count"] == sum(v >= every[0] - 1e-12 for v in every) and r.count_abs == sum(abs(v) >= abs(every[0]) - 1e-12 for v in every)
    mc = qap.qap_monte_carlo(spark.createDataFrame(full, "i int, j int, predictor double, target double"), n, 3000, 1, which).first()
    assert abs(mc.p - r.p) < 0.05


def test_left_out_matches_closed_form(spark):
    rng = random.Random(6)
    v = {(m, c, d): rng.gauss(0, 1) for m in "abcd" for c in "xy" for d in range(3)}
    df = spark.createDataFrame([(*k, x) for k, x in v.items()], "model string, condition string, dim int, v double")
    for r in additive.left_out(df).collect():
        other = "y" if r.condition == "x" else "x"
        rest = [m for m in "abcd" if m != r.model]
        here = sum(v[m, r.condition, r.dim] for m in rest) / 3
        there = sum(v[m, other, r.dim] for m in rest) / 3
        assert math.isclose(r.task_only, here, abs_tol=1e-12) and math.isclose(r.additive, v[r.model, other, r.dim] + here - there, abs_tol=1e-12)


def test_two_way_demeaning_and_correlations(spark):
    rng = random.Random(7)
    rows = [(f"g{rng.randrange(4)}", f"s{rng.randrange(9)}", float(rng.randint(0, 20)), float(rng.randint(0, 20))) for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, s string, x double, y double")
    out = ranking.two_way_demean(df.withColumn("id", F.monotonically_increasing_id()), "x", "g", "s", rounds=50)
    for by in ("g", "s"):
        assert all(abs(r.m) < 1e-6 for r in out.groupBy(by).agg(F.avg("demeaned").alias("m")).collect())
    assert math.isclose(cluster.spearman(df, [], "x", "y").first().rho, brute_rho([r[2] for r in rows], [r[3] for r in rows]), abs_tol=1e-12)
    flat = df.withColumn("x", F.lit(1.0))
    assert cluster.spearman(flat, [], "x", "y").first().rho is None
    assert bootstrap.boot_p is not None and spark.range(10).agg(bootstrap.boot_p(F.col("id") + 1.0, 10)).first()[0] == 0.2


@pytest.mark.parametrize("which", ["upper", "lower", "ordered"])
def test_delete_one_is_the_exact_test_of_each_smaller_matrix(spark, which):
    rng = random.Random(8)
    value = {(i, j): (rng.random(), rng.random()) for i in range(5) for j in range(i)}
    rows = [(i, j, *(value[max(i, j), min(i, j)])) for i in range(5) for j in range(5) if i != j]
    got = {r.dropped: r.asDict() for r in qap.delete_one(spark.createDataFrame(rows, "i int, j int, predictor double, target double"), 5, which).collect()}
    assert set(got) == set(range(5))
    for d in (0, 2, 4):
        own = [(i - (i > d), j - (j > d), p, t) for i, j, p, t in rows if d not in (i, j)]
        alone = qap.qap_exact(spark.createDataFrame(own, "i int, j int, predictor double, target double"), 4, which).first().asDict()
        assert {k: v for k, v in got[d].items() if k != "dropped"} == pytest.approx(alone) and got[d]["total"] == 24
