"""The source of NPZ and NPY files: round trips, ranges of rows, single members, and files that break the rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.sources import arrays


@pytest.fixture(scope="module")
def source(spark):
    arrays.register(spark)
    return spark


def save(path, compressed=False, n=25, **more):
    members = {"key": np.arange(n), "vector": np.arange(n * 3, dtype=np.float32).reshape(n, 3), "name": np.array([f"ü{k}" for k in range(n)]), "flag": np.arange(n) % 2 == 0, "half": np.arange(n, dtype=np.float16), "big": np.arange(n, dtype=">i4")} | more
    (np.savez_compressed if compressed else np.savez)(path, **members)


@pytest.mark.parametrize("compressed", [False, True])
def test_members_are_columns(source, tmp_path, compressed):
    save(tmp_path / "a.npz", compressed)
    df = source.read.format("arrays").option("rows", 4).load(str(tmp_path))
    assert dict(df.dtypes) == {"key": "bigint", "vector": "array<float>", "name": "string", "flag": "boolean", "half": "float", "big": "int"}
    assert df.rdd.getNumPartitions() == (1 if compressed else 7)
    rows = df.orderBy("key").collect()
    assert [(r.key, list(r.vector), r.name, r.flag, r.half, r.big) for r in rows] == [(k, [3.0 * k, 3.0 * k + 1, 3.0 * k + 2], f"ü{k}", k % 2 == 0, float(k), k) for k in range(25)]


def test_one_member_and_positions(source, tmp_path, monkeypatch):
    save(tmp_path / "a.npz")
    save(tmp_path / "b.npz", key=np.arange(100, 125))
    df = source.read.format("arrays").schema("key long").load(str(tmp_path))
    assert df.agg(F.sum("key")).first()[0] == sum(range(25)) + sum(range(100, 125))
    df = source.read.format("arrays").options(positions="true", rows=6).load(str(tmp_path))
    assert df.select(F.regexp_extract("_file", "[^/]+$", 0), "_row", "key").orderBy("key").collect() == [(f"{'b' if k >= 100 else 'a'}.npz", k % 100, k) for k in [*range(25), *range(100, 125)]]


def test_npy_is_joined_by_row(source, tmp_path):
    np.save(tmp_path / "scores.npy", np.linspace(0, 1, 11))
    np.save(tmp_path / "keys.npy", np.arange(11)[::-1].copy())
    read = lambda name: source.read.format("arrays").options(positions="true", rows=3).load(str(tmp_path / name)).drop("_file")
    met = read("scores.npy").join(read("keys.npy").withColumnRenamed("array", "key"), "_row")
    assert {r.key: round(r.array, 6) for r in met.collect()} == {10 - k: round(k / 10, 6) for k in range(11)}


@pytest.mark.parametrize("compressed", ["false", "true"])
def test_round_trip(source, tmp_path, compressed):
    df = source.range(0, 1000, 1, 3).select("id", F.array(F.col("id") * 1.5, F.lit(2.0)).alias("v"), F.concat(F.lit("ä"), "id").alias("s"), (F.col("id") % 3 == 0).alias("b"))
    path = f"file://{tmp_path}/out"
    df.write.format("arrays").options(rows=150, compressed=compressed).mode("append").save(path)
    assert len(arrays.files_of(path)) == 9
    back = source.read.format("arrays").load(path)
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0
    df.limit(5).write.format("arrays").mode("overwrite").save(path)
    assert source.read.format("arrays").load(path).count() == 5


def breaks(source, path, match, **options):
    with pytest.raises(Exception, match=match):
        source.read.format("arrays").options(**options).load(str(path)).collect()


def test_files_that_break_the_rules(source, tmp_path):
    def place(name):
        (tmp_path / name).mkdir()
        return tmp_path / name

    whole = place("cut") / "a.npz"
    save(whole)
    whole.write_bytes(whole.read_bytes()[:-200])
    breaks(source, whole.parent, "a.npz")
    short = place("short") / "a.npy"
    np.save(short, np.arange(100))
    short.write_bytes(short.read_bytes()[:-8])
    breaks(source, short.parent, "792 bytes of 800")
    save(place("lengths") / "a.npz", other=np.arange(3))
    breaks(source, tmp_path / "lengths", "different length")
    np.savez(place("objects") / "a.npz", a=np.array([{}, None], dtype=object))
    breaks(source, tmp_path / "objects", "objects")
    np.savez(place("order") / "a.npz", a=np.asfortranarray(np.ones((3, 4))))
    breaks(source, tmp_path / "order", "Fortran")
    np.savez(place("cube") / "a.npz", a=np.ones((2, 2, 2)))
    breaks(source, tmp_path / "cube", "3 dimensions")
    save(place("mixed") / "a.npz")
    save(tmp_path / "mixed" / "b.npz", key=np.arange(25) * 0.5)
    breaks(source, tmp_path / "mixed", "b.npz: member key is double, not bigint")
    breaks(source, place("none"), "no array files")


@pytest.mark.parametrize("values", ["NULL", "array(1.0, 2.0), array(1.0)", "array(1.0, NULL)"])
def test_what_arrays_cannot_hold(source, tmp_path, values):
    with pytest.raises(Exception, match="nulls|different length"):
        source.sql(f"SELECT explode(array({values})) AS v").coalesce(1).write.format("arrays").mode("append").save(str(tmp_path / "x"))
    assert not [p for p in (tmp_path / "x").rglob("*.npz")]
