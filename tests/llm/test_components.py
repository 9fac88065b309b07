"""Components of long chains: rounds stay few, and neither their time nor their estimates grow."""

from __future__ import annotations

import time

from brute import near
from pyspark.sql import functions as F

from sievemark.llm import components as module
from sievemark.llm.near_dedup import near_classes


def test_path_of_2000_links(spark, monkeypatch):
    sizes, times = [], [time.perf_counter()]
    written = module.written

    def watched(df):
        out = written(df)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        times.append(time.perf_counter())
        return out

    monkeypatch.setattr(module, "written", watched)
    # a path in the order of a permutation, so that labels have far to go
    place = (F.col("id") * 7919) % 2003
    links = spark.range(2002).select(place.alias("a"), (((F.col("id") + 1) * 7919) % 2003).alias("b"))
    found = module.components(links).collect()
    assert len(found) == 2003 and {r.component for r in found} == {0}
    assert max(sizes) < 10_000_000 and len(sizes) < 40
    rounds = [b - a for a, b in zip(times[2:], times[3:], strict=False)]
    assert max(rounds) < 5 * (sum(rounds) / len(rounds)) + 2


def test_two_cycles_and_a_pair(spark):
    pairs = [(k, (k + 1) % 50) for k in range(50)] + [(100 + k, 100 + (k + 7) % 20) for k in range(20)] + [(300, 299), (5, 5)]
    found = {r.node: r.component for r in module.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(50), 0), **dict.fromkeys(range(100, 120), 100), 299: 299, 300: 299}


def test_variants_of_a_template(spark):
    """Each text differs from the one before it by one word of a hundred, so that links form a chain."""
    words = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(61):
        rows.append((k, " ".join(words)))
        words[(k * 37) % 100] = f"new{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_classes(spark, df).select("doc_id", "n_shingles", "component_id").collect())) == near(rows)
