"""Configurations as VARIANT: leaves, replacement and comparison against dictionaries in Python."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from sievemark.functions import configs

DOCUMENTS = {
    1: {"a": 1, "b": {"c": [1, {"d": 2}], "e": {"f": None, "g": "x\"y"}}, "z.z": True},
    2: {},
    3: [1, 2],
    4: {"deep": {"deep": {"deep": {"deep": {"k": 0.5}}}}},
    5: {"a": {}, "ü": "é"},
    6: "text",
}


def flat(v, path=()):
    return [x for k in v for x in flat(v[k], (*path, k))] if isinstance(v, dict) and v else [(path, v)]


def put(v, path, value):
    v = copy.deepcopy(v) if isinstance(v, dict) else {}
    v[path[0]] = value if len(path) == 1 else put(v.get(path[0]), path[1:], value)
    return v


def canonical(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, json.dumps(v)) for k, v in DOCUMENTS.items()] + [(7, None)]
    return spark.createDataFrame(rows, "id int, text string").select("id", F.parse_json("text").alias("config"))


def test_leaves_and_back(documents):
    found = configs.leaves(documents, ["id"], "config")
    assert sorted(((r.id, tuple(r.path)), json.loads(r.value)) for r in found.collect()) == sorted(((k, p), v) for k, d in DOCUMENTS.items() for p, v in flat(d))
    assert {r.id: r.config for r in configs.documents_of(found, ["id"]).collect()} == {k: canonical(v) for k, v in DOCUMENTS.items()}


@pytest.mark.parametrize("path", [("b", "e", "f"), ("b",), ("a", "under")])
def test_replaced(documents, path):
    made = {r.id: r.text for r in configs.replaced(documents, ["id"], "config", {path: F.concat(F.lit('{"v":'), F.col("id"), F.lit("}"))}).select("id", F.to_json("config").alias("text")).collect()}
    assert made.pop(7) is None
    assert made == {k: canonical(put(v, path, {"v": k})) for k, v in DOCUMENTS.items() if isinstance(v, dict)} | {k: canonical(put(None, path, {"v": k})) for k in (3, 6)}


def test_differences(spark, documents):
    a = configs.leaves(documents, ["id"], "config")
    assert configs.differences(a, a, ["id"]).count() == 0
    b = configs.leaves(configs.replaced(documents.where("id <> 6"), ["id"], "config", {("a",): F.lit("9")}).where("id IN (1, 2, 6)"), ["id"], "config")
    found = {(r.id, tuple(r.path)): (r.left, r.right) for r in configs.differences(a.where("id IN (1, 2, 6)"), b, ["id"]).collect()}
    assert found == {(1, ("a",)): ("1", "9"), (2, ()): ("{}", None), (2, ("a",)): (None, "9"), (6, ()): ('"text"', None)}


def test_conflicts_stop(spark):
    rows = spark.createDataFrame([(1, ["a"], "1"), (1, ["a", "b"], "2")], "id int, path array<string>, value string")
    with pytest.raises(Exception, match="leaf and an object"):
        configs.documents_of(rows, ["id"]).collect()
    assert configs.documents_of(rows.where("false"), ["id"]).collect() == []
