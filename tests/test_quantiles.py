"""Exact quantiles by narrowing, against numpy: small ranges and coarse sketches force many rounds."""

from __future__ import annotations

import numpy as np
import pytest

from sievemark.operators import quantiles

SHARES = {"least": 0.0, "low": 0.025, "mid": 0.5, "high": 0.975, "most": 1.0}


def sets():
    rng = np.random.default_rng(4)
    return {
        "even": rng.random(3000),
        "heavy": np.exp(rng.standard_normal(3000) * 40),
        "two": np.array([0.0] * 1500 + [1.0] * 1500),
        "ties": rng.integers(0, 5, 3000).astype(float),
        "one": np.array([7.5]),
        "same": np.full(2000, 3.0),
        "pair": np.array([1.0, 2.0]),
    }


@pytest.mark.parametrize(("few", "accuracy"), [(quantiles.FEW, quantiles.ACCURACY), (20, 50)])
def test_groups(spark, few, accuracy):
    held = sets()
    rows = [(g, float(v)) for g, x in held.items() for v in x] + [("even", None), (None, 4.0), (None, 6.0), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in quantiles.linear_quantiles(df, ["g"], "v", SHARES, few, accuracy).collect()}
    assert set(got) == {*held, None} and got[None].mid == 5.0
    for g, x in held.items():
        for name, share in SHARES.items():
            assert got[g][name] == pytest.approx(np.quantile(x, share), rel=1e-12), (g, name)


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)], "v double")
    assert quantiles.linear_quantiles(df, [], "v", {"q": 0.255}).first().q == pytest.approx(25.5)
    assert quantiles.linear_quantiles(df.where("false"), [], "v", {"q": 0.5}).collect() == []
