"""Masked means of token rows against sums in Python."""

from __future__ import annotations

import pytest

from sievemark.operators import views


def test_masked_mean(spark):
    weights = spark.createDataFrame([(t, [float(t), t * t / 3.0]) for t in range(8)] + [(9, [1.0]), (10, None)], "token long, vector array<double>")
    texts = {"a": [1, 2, 3], "b": [5, 5, 5], "short": [1, 2], "long": [1, 2, 3, 4], "unknown": [1, 2, 99], "narrow": [1, 2, 9], "none": [1, 2, 10], "empty": []}
    rows = [(k, t, True) for k, x in texts.items() for t in x] + [(k, t, m) for k in texts for t, m in ((0, False), (7, False), (1, None))]
    tokens = spark.createDataFrame(rows, "id string, token long, keep boolean").repartition(4)
    got = {r.id: r for r in views.masked_mean(tokens, weights, ["id"], 3, 2).collect()}
    assert {k: (r.kept, r.status) for k, r in got.items()} == {"a": (3, "ok"), "b": (3, "ok"), "short": (2, "count"), "long": (4, "count"), "unknown": (3, "weights"), "narrow": (3, "weights"), "none": (3, "weights"), "empty": (0, "count")}
    assert got["a"].mean == pytest.approx([2.0, 14 / 9]) and got["b"].mean == pytest.approx([5.0, 25 / 3]) and got["short"].mean is None
    padded = tokens.unionByName(spark.createDataFrame([("a", 3, False)] * 20, tokens.schema))
    assert {r.id: r.mean for r in views.masked_mean(padded, weights, ["id"], 3, 2).collect()} == {k: r.mean for k, r in got.items()}
