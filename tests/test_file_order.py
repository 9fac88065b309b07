"""Numbers of rows in the order of files, lines that JSON readers reject, and contracts by position."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievemark.operators import gates
from sievemark.sources import files


@pytest.fixture
def small_splits(spark):
    """Splits of 2 KB, so that files have several, and partitions hold splits of several files."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_are_numbered_over_splits(spark, tmp_path, small_splits):
    sizes = [900, 0, 3, 400, 1]
    for k, n in enumerate(sizes):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k}:{i}\n" for i in range(n)))
    read = spark.read.text(str(tmp_path))
    assert read.rdd.getNumPartitions() > 3
    found = files.numbered_rows(read).collect()
    assert sorted((r.place, r.row, r.value) for r in found) == [(sum(sizes[:k]) + i, i, f"{k}:{i}") for k, n in enumerate(sizes) for i in range(n)]
    assert {r.value for r in files.first_rows(files.numbered_rows(read), 902).collect()} == {f"0:{i}" for i in range(900)} | {"2:0", "2:1"}


def test_csv_with_headers_and_quoted_lines(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"c{k}.csv").write_text("id,text\n" + "".join(f'{k * 10 + i},"a ""b""\nline {i}"\n' for i in range(10)))
    found = files.numbered_rows(files.read_csv(spark, str(tmp_path), "id int, text string")).collect()
    assert sorted((r.place, r.id, r.row) for r in found) == [(i, i, i % 10) for i in range(30)]


def test_rejected_lines_have_file_and_line(spark, tmp_path, small_splits):
    good = '{"id":1,"name":"x","more":[1]}\n'
    (tmp_path / "a.jsonl").write_text(good * 100 + "\n  \n" + '{"id":2\n' + good + "[1]\n" + '"text"\nnull\n' + '{"id":"no"}\n{}\n')
    (tmp_path / "b.jsonl").write_bytes(b'{"id":7}\r\n\r\n{"id":8,}\r\n' + '{"name":"ü"}'.encode())
    rows, rejects = files.read_json_lines(spark, str(tmp_path), "id long, name string")
    name = F.regexp_extract("file", "[^/]+$", 0)
    told = sorted(map(tuple, rejects.select(name, "line", "reason").collect()))
    assert told == [("a.jsonl", 103, "broken"), ("a.jsonl", 105, "not an object"), ("a.jsonl", 106, "not an object"), ("a.jsonl", 107, "not an object"), ("a.jsonl", 108, "fields"), ("b.jsonl", 3, "broken")]
    kept = {(r[0], r.line): (r.id, r.name) for r in rows.select(name, "line", "id", "name").collect()}
    assert len(kept) == 104 and kept["a.jsonl", 104] == (1, "x") and kept["a.jsonl", 109] == (None, None) and kept["b.jsonl", 1] == (7, None) and kept["b.jsonl", 4] == (None, "ü")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.jsonl").write_text("")
    rows, rejects = files.read_json_lines(spark, str(tmp_path / "none"), "id long")
    assert rows.count() == rejects.count() == 0


def broken(df):
    return sorted((r.rule, r.key, r.detail) for r in df.collect())


def test_positions(spark):
    rules = {"label": (F.col("label") == F.col("place") % 2, F.col("label"))}
    rows = lambda *x: spark.createDataFrame(list(x), "place long, label int")
    assert broken(gates.positions(rows((0, 0), (1, 1), (2, 0)), "csv", "place", 3, rules)) == []
    assert broken(gates.positions(rows((0, 0), (1, 0), (2, None)), "csv", "place", 3, rules)) == [("label", "1", "0"), ("label", "2", "null")]
    assert broken(gates.positions(rows((0, 0), (2, 0)), "csv", "place", 2, rules)) == [("rows", "2", "")]
    assert broken(gates.positions(rows((0, 0)), "csv", "place", 2, rules)) == [("rows", "1", "")]
    assert broken(gates.positions(rows(), "csv", "place", 0, rules)) == []


def test_zip_by_place(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "place long, text string")
    right = spark.createDataFrame([(0, "a"), (1, "x"), (3, "c")], "place long, text string")
    same = {"same": (F.col("text") == F.col("_other.text"), F.col("_other.text"))}
    assert broken(gates.zipped(left, right, "zip", "place", same)) == [("left", "3", ""), ("right", "2", ""), ("same", "1", "x")]
    assert broken(gates.zipped(left, left.na.fill("c"), "zip", "place", same)) == [("same", "2", "c")]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, []),
        ({1: (1, "B", "t")}, [("text", "1", "nowhere")]),
        ({1: (1, "c", "t")}, [("text", "1", "2")]),
        ({1: (2, "c", "t")}, [("missing", "1", ""), ("unique", "2", "2")]),
        ({1: (9, "b", "t")}, [("missing", "1", ""), ("unexpected", "9", "")]),
        ({1: (1, "b", " ")}, [("topic blank", "1", "")]),
        ({1: (1, None, None)}, [("text", "1", "nowhere"), ("topic blank", "1", "")]),
    ],
)
def test_topics_against_texts(spark, change, expected):
    humans = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i long, text string")
    rows = [change.get(k, (k, t, "t")) for k, t in enumerate("abc")]
    assert broken(gates.matched_texts(spark.createDataFrame(rows, "i long, own string, topic string"), humans, "topics", "i", "own", "topic")) == expected
