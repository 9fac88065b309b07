"""Merkle locks against hashing in Python: roots, proofs, changes; hashes of ordered lists."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import gates, locks, manifests


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(rows):
    """Levels of hashes, from the leaves."""
    leaf = lambda p, d: sha("leaf:" + json.dumps({"path": p, "digest": d}, separators=(",", ":"), ensure_ascii=False))
    levels = [[h for _, h in sorted((p, leaf(p, d)) for p, d in rows)]]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("node:" + ",".join(x[i : i + 16])) for i in range(0, len(x), 16)])
    return levels


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    return [(f"p{k}ü", sha(str(rnd.random()))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, digest string")


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_root_and_proofs(spark, n):
    rows = rows_of(n) + [("p0ü", None)] * (n == 17)
    lock = locks.build(frame(spark, rows).repartition(5))
    levels = tree(rows)
    root = lock.root().first()
    assert (root.lock_sha256, root.n, len(lock.levels)) == (levels[-1][0], len(rows), len(levels))
    assert all(max((len(r.children) for r in locks._families(x).collect()), default=0) <= locks.FANOUT for x in lock.levels)
    found = locks.proofs(lock)
    ok = locks.proved(F.col("place"), F.col("hash"), F.col("families"), F.lit(root.lock_sha256))
    assert found.select(ok.alias("ok")).distinct().collect()[0].ok is True and found.count() == len(rows)
    one = locks.proofs(lock, frame(spark, rows[:1])).collect()
    assert {r.path for r in one} == {rows[0][0]} and [len(x) for x in one[0].families] == [min(16, len(levels[k]) - one[0].place // 16 ** (k + 1) * 16) for k in range(len(levels) - 1)]


def test_proofs_that_lie(spark):
    lock = locks.build(frame(spark, rows_of(300)))
    root = lock.root().first().lock_sha256
    proof = locks.proofs(lock, frame(spark, rows_of(300)[:1]))
    ok = lambda place="place", own="hash", families="families", at=root: proof.select(locks.proved(F.expr(place), F.expr(own), F.expr(families), F.lit(at)).alias("x")).first().x
    assert ok() and not ok(place="place + 1") and not ok(own="sha2('leaf:x', 256)") and not ok(at=sha("x")) and not ok(place="place + 4096")
    assert not ok(families="slice(families, 1, 2)") and not ok(families="transform(families, x -> reverse(x))")


def test_a_changed_row_is_named(spark):
    rows = rows_of(600)
    before = locks.build(frame(spark, rows))
    later = [(p, "0" if k in (3, 250) else d) for k, (p, d) in enumerate(rows)]
    assert {r.new_path for r in locks.changed(before, locks.build(frame(spark, later))).collect()} == {rows[3][0], rows[250][0]}
    assert locks.changed(before, locks.build(frame(spark, rows).repartition(7))).count() == 0
    gone = locks.changed(before, locks.build(frame(spark, sorted(rows)[:-1]))).collect()
    assert [(r.old_path, r.new_path) for r in gone] == [(sorted(rows)[-1][0], None)]
    assert locks.changed(locks.build(frame(spark, rows[:10])), locks.build(frame(spark, rows[:300]))).count() > 0


def test_empty_saved_and_repeated(spark, tmp_path):
    assert locks.build(frame(spark, [])).root().first().lock_sha256 == sha("empty:")
    rows = rows_of(40) + rows_of(40)[:3]
    lock = locks.build(frame(spark, rows))
    lock.save(str(tmp_path / "lock"))
    again = locks.load(spark, str(tmp_path / "lock"))
    assert again.root().first() == lock.root().first() and again.n == 43 and locks.changed(lock, again).count() == 0
    assert gates.lock_digest(frame(spark, rows[::-1])).first()[0] == tree(rows)[-1][0]


def test_ordered_lists(spark, monkeypatch):
    monkeypatch.setattr(locks, "PACK", 4)
    rows = [(g, f'i"{k}\\ü', k * 37 % 101) for g in ("a", None, "c") for k in range(50 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, item string, at int").repartition(6)
    got = {r.g: (r.n, r.ids_sha256) for r in manifests.ordered_ids(df, ["g"], "item", "at").collect()}
    for g in ("a", None, "c"):
        ids = [i for h, i, _ in sorted((x for x in rows if x[0] == g), key=lambda x: x[2])]
        assert got[g] == (len(ids), sha(json.dumps(ids, separators=(",", ":"), ensure_ascii=False)))
