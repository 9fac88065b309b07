"""Gates on views, refits, rewrite panels and weight directories: one changed field a rule; and rows that had no test."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sievemark.operators import detector, gates, manifests, view_gates, views
from sievemark.sources import files


def broken(df):
    return sorted((r.rule, r.key, r.detail) for r in df.collect())


PAIR = "id int, human_ids array<int>, generated_ids array<int>, human_view array<int>, generated_view array<int>"


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, []),
        ({"human_view": [1, 3]}, [("human prefix", "0", "2")]),
        ({"generated_view": [4]}, [("generated prefix", "0", "1")]),
        ({"generated_view": None}, [("generated prefix", "0", "null")]),
        ({"human_ids": [1], "human_view": None}, [("human tokens", "0", "1")]),
        ({"human_ids": [1], "human_view": [1]}, [("human prefix", "0", "1"), ("human tokens", "0", "1")]),
        ({"human_ids": None, "human_view": None}, [("human tokens", "0", "null")]),
    ],
)
def test_analysis_views(spark, change, expected):
    good = {"id": 0, "human_ids": [1, 2, 3], "generated_ids": [4, 5], "human_view": [1, 2], "generated_view": [4, 5]}
    rows = [tuple((good | change).values()), (1, [1, 2], [1, 2, 3], [1, 2], [1, 2])]
    assert broken(view_gates.analysis_views(spark.createDataFrame(rows, PAIR), ["id"], 2)) == expected


def test_repeated_pairs_and_minima(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3], [4, 5], [1, 2], [4, 5])] * 2 + [(1, [1, 2, 3, 4], [1, 2, 3], [1, 2], [1, 2])], PAIR)
    assert broken(view_gates.analysis_views(rows, ["id"], 2)) == [("unique", "0", "2")]
    assert tuple(view_gates.pair_minima(rows, 2).first()) == (3, 3, 2, 2, 0, "ok")
    assert tuple(view_gates.pair_minima(rows, 3).first()) == (3, 3, 2, 2, 2, "failed")


def test_paired_views_are_recovered(spark):
    rows = spark.createDataFrame([(i, "a" if i < 2 else "b", [1, 2], [3, 4]) for i in range(3)], "id int, cell string, human_view array<int>, generated_view array<int>")
    for side in view_gates.SIDES:
        ids, mask = views.with_boundaries(F.col(f"{side}_view"), 0, 9)
        rows = rows.withColumns({f"{side}_ids": ids, f"{side}_mask": mask})
    check = lambda df, n=2: broken(view_gates.paired_views(df, ["id"], ["cell"], 2, n))
    assert check(rows) == [("pairs", "b", "1")]
    two = rows.where("cell = 'a'")
    assert check(two) == []
    assert check(two.withColumn("human_ids", F.array(F.lit(0), F.lit(1), F.lit(7), F.lit(9)))) == [("human recovered", "0", ""), ("human recovered", "1", "")]
    wide = F.array(F.lit(True), F.lit(True), F.lit(True), F.lit(False))
    assert check(two.where("id = 0").withColumn("generated_mask", wide), 1) == [("generated mask", "0", "3"), ("generated recovered", "0", "")]
    assert ("human length", "0", "3") in check(two.where("id = 0").withColumn("human_ids", F.slice("human_ids", 1, 3)), 1)
    assert check(two.unionByName(two.where("id = 0")).where("id = 0")) == [("pairs", "a", "2")]


def test_refits(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "cell string, a double, n long")
    good = frame(("x", 0.1, 1), ("y", float("nan"), None), ("z", None, 3))
    assert broken(view_gates.refit(good, good, ["cell"], ["a", "n"])) == []
    off = frame(("x", 0.1 + 1e-12, 1), ("y", 0.5, None), ("z", None, 4))
    assert [r[:2] for r in broken(view_gates.refit(off, good, ["cell"], ["a", "n"]))] == [("a", "x"), ("a", "y"), ("n", "z")]
    assert [r[:2] for r in broken(view_gates.refit(off, good, ["cell"], ["a", "n"], 1e-9))] == [("a", "y"), ("n", "z")]
    assert [r[:2] for r in broken(view_gates.refit(good.where("cell <> 'x'"), good, ["cell"], ["a"]))] == [("missing", "x")]
    assert ("unique", "x", "2") in broken(view_gates.refit(good.union(good.where("cell = 'x'")), good, ["cell"], ["a"]))


def test_rewrite_sources(spark):
    first = spark.createDataFrame([("s1", "h1", "train"), ("s2", "h2", "val")], "source_id string, human_sha256 string, split_origin string")
    check = lambda df: broken(view_gates.same_humans(df, first, ["human_sha256", "split_origin"]))
    assert check(first.union(first)) == []
    assert check(first.where("source_id = 's1'")) == [("missing", "s2", "")]
    assert check(first.withColumn("human_sha256", F.when(F.col("source_id") == "s1", "h1"))) == [("human_sha256", "s2", "null")]
    assert check(first.union(first.withColumn("split_origin", F.lit("train")))) == [("one identity", "s2", "2"), ("split_origin", "s2", "train")]


def digests(data):
    return len(data), hashlib.sha256(data).hexdigest(), hashlib.sha1(f"blob {len(data)}\0".encode() + data).hexdigest()


def test_weight_directories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_CHUNK", 7)
    blobs, snapshot, away = tmp_path / "blobs", tmp_path / "snapshot", tmp_path / "away"
    for d in (blobs, snapshot, away):
        d.mkdir()
    data = {"config.json": b"{}", "model.bin": b"weights" * 11, "empty": b""}
    for k, v in data.items():
        (blobs / k).write_bytes(v)
        os.symlink(f"../blobs/{k}", snapshot / k)
    (snapshot / ".lock").write_text("x")
    schema = "name string, length long, sha256 string, sha1 string"
    pins = [(k, *digests(v)) for k, v in data.items()]
    pinned = spark.createDataFrame([*pins[:1], (*pins[1][:3], None), pins[2]], schema)
    check = lambda pinned=pinned, **more: broken(files.directory_gate(files.directory_digests(spark, str(snapshot), (".lock",)), pinned, str(blobs), **more))
    assert check() == []
    wrong = spark.createDataFrame([("config.json", 3, pins[0][2], pins[0][3]), ("model.bin", pins[1][1], "0", None), ("empty", 0, pins[2][2], "0")], schema)
    assert [r[:2] for r in check(wrong)] == [("length", "config.json"), ("sha1", "empty"), ("sha256", "model.bin")]
    (away / "x.bin").write_bytes(b"x")
    os.symlink("../away/x.bin", snapshot / "x.bin")
    assert [r[:2] for r in check()] == [("unexpected", "x.bin")]
    extra = spark.createDataFrame([("x.bin", *digests(b"x")), ("not there", 1, None, None)], schema)
    assert [r[:2] for r in check(extra=extra)] == [("link leads outside", "x.bin")]
    (snapshot / "x.bin").unlink()
    (snapshot / "empty").unlink()
    (snapshot / "empty").mkdir()
    assert [r[:2] for r in check()] == [("regular file", "empty")]
    (snapshot / "empty").rmdir()
    assert [r[:2] for r in check()] == [("missing", "empty")]


# --- rows that had no test -----------------------------------------------------------------------------------------


def test_eligibility(spark):
    rows = [("train", " TRUE ", 100), ("train", "false", 100), ("val", "true", 100), ("train", "true", 99), ("train", "true", 201), ("train", "True", 200), ("train", None, 150)]
    df = spark.createDataFrame(rows, "split_origin string, include string, human_word_count int")
    assert [tuple(r) for r in manifests.eligible(df, "train", "include", 100, 200).collect()] == [rows[0], rows[5]]


def test_ordered_ids_as_a_contract(spark):
    df = spark.createDataFrame([("a", 0, "x", "x"), ("a", 1, "y", "z"), ("b", 0, None, "x"), ("b", 1, None, None)], "cell string, place int, id string, wanted string")
    assert broken(gates.order(df, "ids", ["cell"], "place", "id", "wanted")) == [("order", "a|1", "y"), ("order", "b|0", "null")]


def test_ladder_and_plotted_ceilings(spark):
    rows = [(v, c, a) for v, x in {128: {"a": 1.0, "b": 0.99995}, 64: {"a": 0.9999, "b": 0.99989}}.items() for c, a in x.items()]
    df = spark.createDataFrame(rows, "view int, cell string, auroc double")
    assert sorted(map(tuple, views.view_ceilings(df).collect())) == [(64, 0, 1), (128, 1, 2)]
    assert {r.cell: (r["128"], r["64"], r["32"]) for r in views.ladder(df).collect()} == {"a": (1.0, 0.9999, None), "b": (0.99995, 0.99989, None)}


def test_whole_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "status": "ok",\n "n": 3\n}\n')
    (tmp_path / "b.json").write_text('{"status": "no"}')
    found = files.read_documents(spark, str(tmp_path), "status string, n int").collect()
    assert sorted((os.path.basename(r.path), r.status, r.n) for r in found) == [("a.json", "ok", 3), ("b.json", "no", None)]


def test_a_fit_without_convergence_stops(spark):
    rows = [(k, [float(k % 7), float(k * k % 11)], k % 2 == 0, "train" if k % 3 else "val") for k in range(60)]
    df = spark.createDataFrame(rows, "id int, vector array<double>, made boolean, split string")
    with pytest.raises(RuntimeError, match="no convergence"):
        detector.logistic_grid(df, "vector", "made", "split", (1.0,), max_iterations=1)
