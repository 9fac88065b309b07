"""Bootstraps in blocks of replicates give what weights and scores that meet in a shuffle give, and what counting gives."""

from __future__ import annotations

import pytest

from sievemark.operators import bootstrap


def rows_of(spark):
    # ties between and within sides, a cell without all sources, repeated sources, text and number ids
    rows = [(c, f"s{k}", (k * 7 + len(c)) % 5, (k * 3) % 6) for c in ("a", "bb", "ccc") for k in range(17) if c != "bb" or k % 4 == 1]
    return spark.createDataFrame(rows + [("a", "s3", 2, 2)], "cell string, source string, human long, generated long")


@pytest.mark.parametrize("block", [1, 40, bootstrap.BLOCK])
def test_both_ways_agree(spark, monkeypatch, block):
    df = rows_of(spark)
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    near = {(r.rep, r.cell): r.auroc for r in bootstrap.samples(df, 60, 11).collect()}
    monkeypatch.setattr(bootstrap, "PLACES", 0)
    far = {(r.rep, r.cell): r.auroc for r in bootstrap.samples(df, 60, 11).collect()}
    assert near == far and len(near) > 120


def test_by_counting(spark):
    df = rows_of(spark)
    drawn = bootstrap.draws(spark, 8, 17, 5).collect()
    order = sorted({r.source for r in df.collect()})
    got = {(r.rep, r.cell): r.auroc for r in bootstrap.samples(df, 8, 5).collect()}
    for rep in range(8):
        for cell in ("a", "bb", "ccc"):
            picked = [r for d in drawn if d.rep == rep for r in df.collect() if r.cell == cell and r.source == order[d.place]] if rep < 2 else None
            if picked:
                wins = sum((x.generated > y.human) + (x.generated == y.human) / 2 for x in picked for y in picked)
                assert abs(got[rep, cell] - wins / len(picked) ** 2) < 1e-12


def test_nothing_to_draw(spark):
    assert bootstrap.samples(rows_of(spark).where("false"), 5, 1).collect() == []
