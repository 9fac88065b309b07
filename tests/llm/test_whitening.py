"""Whitening against a direct eigendecomposition of exact covariances."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sievemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=32):
    """(components, {(vec_id, place): deviation}, whitened matrix up to sign, shares) of rows (vec_id, vector)."""
    width = max((len(v) for _, v in rows if v), default=0)
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    exact = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    y = np.array(exact, float) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    m = int((values[:k] > 1e-9 * values[0]).sum())
    return [i for i, _ in kept], [sum(a * a for a in r) for r in exact], y @ basis[:, :m] / np.sqrt(values[:m]), values[:m] / values.sum(), n


def check(spark, rows, k=32, df=None, atol=1e-7):
    df = spark.createDataFrame(rows, SCHEMA) if df is None else df
    got = whitening.whiten(spark, df, k).collect()
    ids, deviations, white, shares, n = brute([(r[0], r[1]) for r in rows], k)
    m = len(shares)
    assert len(got) == len(ids) * m
    found = np.full(white.shape, np.nan)
    for r in got:
        at = ids.index(r.vec_id)
        assert (r.n, r.deviation) == (n, deviations[at])
        assert abs(r.explained - shares[r.component - 1]) <= 1e-10 * shares[0]
        assert r.identity_error <= 1e-9
        found[at, r.component - 1] = r.whitened
    signs = np.sign((found * white).sum(axis=0))
    assert np.allclose(found * signs, white, atol=atol)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding) for r in df.collect()], df=df)


def random_rows(n, d, decay, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.standard_normal((n, d)) @ np.diag(np.exp(-decay * np.arange(d))) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [(k, [float(c) for c in v], 0) for k, v in enumerate(values.astype(np.float32) * 30)]


@pytest.mark.parametrize("decay", [0.002, 0.05])
def test_subspace_is_narrowed(spark, monkeypatch, decay):
    """Twelve directions a block in 150 dimensions: several passes, and subspaces narrowed to their best vectors."""
    passes = []
    summed = whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda *a: passes.append(a[3]) or summed(*a))
    rows = spark.createDataFrame(random_rows(500, 150, decay), SCHEMA).repartition(3)
    n, sums = whitening.centre(whitening.vectors(rows))
    monkeypatch.setattr(whitening, "KEPT", 5)
    values, basis, trace = whitening.components(whitening.vectors(rows), n, sums, 4, 8)
    x = np.array([[math.floor(64 * float(np.float32(c))) for c in r.embedding] for r in rows.collect()], float)
    expected = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert len(passes) > 3
    assert np.allclose(values, expected[:4], rtol=1e-11)
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-12)
    assert abs(trace / expected.sum() - 1) < 1e-12


def test_odd_rows(spark):
    rows = random_rows(40, 5, 0.1)
    odd = [(100, None, 0), (101, [], 0), (102, [1.0, 2.0], 0), (103, [1.0, None, 2.0, 3.0, 4.0], 0), (104, [float("nan")] * 5, 0), (105, [1.0, float("-inf"), 0.0, 0.0, 0.0], None)]
    check(spark, rows + odd)
    check(spark, odd + rows[:3] + [(200, rows[0][1], 1)])  # fewer vectors than dimensions, one repeated


def test_nothing_to_whiten(spark):
    assert whitening.whiten(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark, spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).collect() == []
    assert whitening.whiten(spark, spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect() == []


def test_null_ids_and_other_columns(spark):
    rows = [(None, [1.0, 2.0], 3, 4.0, "c"), (None, [2.0, 1.0], 3, 4.0, "c"), (1, [2.0, 5.0], 3, 4.0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened double, component string")
    got = whitening.whiten(spark, df).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1"] * 2 + ["None"] * 4 and {r.n for r in got} == {3}


def test_overflow_is_told(spark):
    with pytest.raises(Exception, match="fit a long"):
        whitening.whiten(spark, spark.createDataFrame([(1, [1e30, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect()
