"""Gates: a clean table passes, and one changed field gives one violation. Files: round trips. Streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievemark.functions import text
from sievemark.operators import detector, gates, manifests, views
from sievemark.sources import files
from sievemark.streaming import endpoints as stream

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture
def queue(spark):
    rows = [(f"arxiv2k:{i:04d}", i, "train", "main", sha(f"human {i}"), f"topic {i}", sha(f"topic {i}"), 100 + i, 90, 130) for i in range(4)]
    return spark.createDataFrame(rows, files.QUEUE)


@pytest.fixture
def panel(spark, queue):
    contract = spark.createDataFrame([("stage", c, "run", "main", "main", "model", "a" * 40, 2) for c in ("base", "sft")], "suite string, cell string, run_id string, cohort string, phase string, model_hf_id string, model_revision string, tokens int")
    raw = F.concat(F.lit("out  "), "source_id")
    normal = text.normalize_whitespace(raw)
    rows = contract.drop("tokens").join(queue, "cohort").select(
        F.lit("c").alias("contract_sha256"), "run_id", "suite", "cell", "cohort", "phase", "model_hf_id", "model_revision", "source_id", "human_sha256", "topic_sha256", "compact_index", "split_origin", F.lit(0).alias("attempt"), F.lit("accepted").alias("status"), F.lit(2).alias("output_tokens"),
        F.array(F.lit(1), F.lit(2)).alias("output_token_ids"), F.lit(True).alias("exact_token_count"), raw.alias("raw_output"), normal.alias("normalized_output"), text.sha256_text(raw).alias("raw_output_sha256"), text.sha256_text(normal).alias("normalized_output_sha256"), F.lit("p").alias("prompt_sha256"), F.lit(2).alias("actual_words"),
    )
    return rows, contract


def test_whitespace_is_pythons(spark):
    texts = [f"a{s}b{s}{s} c{s}" for s in SPACES] + ["", " ", "x", "é ö"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalize_whitespace("t"), text.word_count("t")).collect()]
    assert got == [(" ".join(t.split()), len(t.split())) for t in texts]


def test_scalar_functions(spark):
    one = spark.createDataFrame([("a|b", 7, bytearray(b"x\x00y"), "f" * 40 + "\n")], "s string, n int, b binary, rev string")
    r = one.select(text.stable_seed("s", "n", base_seed=3).alias("seed"), text.git_blob_sha1("b").alias("sha"), text.is_revision("rev").alias("bad"), text.is_revision(F.substring("rev", 1, 40)).alias("good"), text.canonical_json("n", "s").alias("json"), text.render("{{{x}}} 100% {x}", x=F.col("n").cast("string")).alias("t")).first()
    assert r.seed == int.from_bytes(hashlib.sha256(b"3|a|b|7").digest()[:8], "big") % (2**31 - 1)
    assert r.sha == hashlib.sha1(b"blob 3\0x\x00y").hexdigest() and not r.bad and r.good
    assert r.json == '{"n":7,"s":"a|b"}' and r.t == "{7} 100% 7"
    low, high = text.word_bounds("n")
    import math

    for x in spark.range(1, 2001).select(F.col("id").alias("n")).select("n", low.alias("low"), high.alias("high")).collect():
        assert (x.low, x.high) == (math.ceil(x.n * 0.9), math.floor(x.n * 1.1))


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"source_id": "arxiv2k:9"}, "source id"),
        ({"topic": "other"}, "sha256 of topic"),
        ({"low_words": 500}, "bounds"),
        ({"split_origin": "dev"}, "split"),
    ],
)
def test_queue_gate(queue, change, rule):
    assert gates.queue(queue).isEmpty()
    first = F.col("compact_index") == 0
    bad = queue.withColumns({k: F.when(first, F.lit(v)).otherwise(F.col(k)) for k, v in change.items()})
    found = gates.queue(bad).collect()
    assert [r.rule for r in found] == [rule]
    with pytest.raises(gates.GateError, match=rule):
        gates.require(gates.queue(bad))


@pytest.mark.parametrize(
    "field, value, rules",
    [
        ("attempt", 1, {"attempt"}),
        ("human_sha256", "x", {"fields"}),
        ("model_revision", "b" * 40, {"fields"}),
        ("status", "exhausted", {"status"}),
        ("output_tokens", 3, {"tokens"}),
        ("raw_output", "x", {"sha256 of raw_output"}),
        ("actual_words", 9, {"words"}),
        ("source_id", "arxiv2k:0001", {"unique", "missing", "fields"}),
    ],
)
def test_result_gate(queue, panel, field, value, rules):
    rows, contract = panel
    assert gates.result_cell(rows, queue, contract).isEmpty()
    first = (F.col("source_id") == "arxiv2k:0000") & (F.col("cell") == "base")
    assert {r.rule for r in gates.result_cell(rows.withColumn(field, F.when(first, F.lit(value)).otherwise(F.col(field))), queue, contract).collect()} == rules


def test_panel_lock_and_other_gates(spark, queue, panel):
    rows, contract = panel
    assert gates.panel(rows, contract).isEmpty()
    cut = rows.where("NOT (cell = 'sft' AND source_id = 'arxiv2k:0003')")
    assert [(r.gate, r.rule) for r in gates.panel(cut, contract).collect()] == [("panel sources", "missing")]
    lines = rows.select(F.concat("cell", "source_id").alias("path"), "raw_output_sha256").withColumnRenamed("raw_output_sha256", "digest")
    same = gates.lock_digest(lines).first()[0]
    assert same == gates.lock_digest(lines.repartition(5)).first()[0] != gates.lock_digest(lines.limit(3)).first()[0]
    assert gates.locked(lines, lines).isEmpty() and gates.locked(lines.limit(3), lines).count() == 5
    assert gates.same_multiset(lines, lines).isEmpty() and gates.same_multiset(lines.union(lines.limit(1)), lines).count() == 1
    assert gates.leaks(queue.withColumn("prompt", F.concat(F.lit("see "), "topic")), queue, "g", ["source_id"], "prompt", "topic").count() == 4
    assert gates.disjoint(queue, queue.where("compact_index > 1"), "g", ["source_id"]).count() == 2
    aurocs = spark.createDataFrame([(v, c, v == 128 and c != "d") for v in (128, 64, 32) for c in "abcd"], "view int, cell string, ceiling boolean")
    assert {r.view: r.authorised for r in gates.descent(aurocs, 3).collect()} == {128: True, 64: False, 32: False}
    assert gates.primary_view(aurocs, list("abc")).first()[0] == 64 and gates.primary_view(aurocs, ["z"]).first()[0] is None


def test_cohorts_and_lookups(spark):
    humans = spark.createDataFrame([(i, f"text {i % 40}", "train" if i % 3 else "val") for i in range(60)], "compact_index int, text string, split_origin string")
    manifest = manifests.source_manifest(humans)
    pilot = manifests.pilot_cohort(manifest, manifest.where("compact_index = 31"), n=5, least=30).collect()
    assert sorted(r.compact_index for r in pilot) == [32, 34, 35, 37, 38]
    queued = manifests.main_cohort(manifest, 0, 9).drop("text")
    assert manifests.with_source_text(queued, manifest).count() == 10
    with pytest.raises(PySparkException, match="hash of"):
        manifests.with_source_text(queued.withColumn("human_sha256", F.lit("x")), manifest).collect()
    numbered = manifests.indexed(humans.select((F.col("compact_index") * 3 + 1).alias("at")), "at")
    assert {(r["at"] - 1) // 3 for r in numbered.collect() if r.compact_index == (r["at"] - 1) // 3} == set(range(60))


def test_views(spark):
    df = spark.createDataFrame([("a b c d",), ("a",), ("",)], "t string")
    ids = views.token_ids("t")
    whole, mask = views.with_boundaries(ids, -1, -2)
    rows = df.select(ids.alias("ids"), views.content_view(ids, 2).alias("view"), views.recovered(whole, mask).alias("back"), views.hashed_embedding(ids, 4).alias("e")).collect()
    assert all(r.ids == r.back for r in rows) and [len(r.view) if r.view else None for r in rows] == [2, None, None] and len(rows[0].e) == 4
    own = views.with_tokenizer(df, "t", lambda texts: [[len(t)] for t in texts]).collect()
    assert [r.ids for r in own] == [[7], [1], [0]]


def test_files(spark, tmp_path, queue, panel):
    files.write_jsonl(queue, str(tmp_path / "q"))
    lines = [x for p in sorted((tmp_path / "q").glob("part-*")) for x in p.read_text().splitlines()]
    assert all(x == json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in lines)
    assert gates.same_multiset(files.read_jsonl(spark, str(tmp_path / "q"), files.QUEUE), queue).isEmpty()
    (tmp_path / "bad.jsonl").write_text('{"source_id": "a"}\n\n[1]\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), files.QUEUE).collect()
    tricky = spark.createDataFrame([('a "b"\nc', 1), ("é, ;", 0)], "text string, generated int")
    files.write_csv(tricky, str(tmp_path / "csv"))
    assert gates.same_multiset(files.read_csv(spark, str(tmp_path / "csv"), "text string, generated int"), tricky).isEmpty()
    for r in panel[0].where("cell = 'base'").collect():
        folder = tmp_path / "cell" / r.source_id.replace(":", "_")
        folder.mkdir(parents=True)
        (folder / "attempt-00.json").write_text(json.dumps(r.asDict(True), indent=2))
    read = files.read_endpoints(spark, str(tmp_path / "cell"))
    assert read.count() == 4 and files.only_first_attempts(read).isEmpty()
    assert gates.same_multiset(read.drop("folder", "file"), panel[0].where("cell = 'base'")).isEmpty()
    (folder / "attempt-01.json").write_text((folder / "attempt-00.json").read_text())
    assert [r.folder for r in files.only_first_attempts(files.read_endpoints(spark, str(tmp_path / "cell"))).collect()] == [folder.name]
    found = files.file_digests(spark, str(tmp_path / "q"), ignore=("_SUCCESS",))
    pinned = found.select("name", "length", "sha256", "sha1")
    assert gates.files(found, pinned).isEmpty() and gates.files(found, pinned.withColumn("sha1", F.lit("x"))).count() == found.count()
    parameters = {"representation": {"content_tokens": 128, "x": 1}, "k": [1]}
    (tmp_path / "c.json").write_text(json.dumps(parameters))
    assert files.read_parameters(spark, str(tmp_path / "c.json")) == parameters
    assert files.changed_paths(parameters, files.with_view_length(parameters, 64)) == ["representation.content_tokens"]


def test_endpoint_stream(spark, tmp_path, panel, queue):
    rows, contract = panel
    good = rows.where("cell = 'base'")
    bad = good.where("compact_index = 2").withColumn("status", F.lit("failed"))
    good.where("compact_index <> 2").union(good.where("compact_index = 1")).union(bad).write.json(str(tmp_path / "in"))
    source = stream.first_of_key(stream.endpoint_stream(spark, str(tmp_path / "in")))
    rule = lambda df: gates.predicate(df, "stream", "status", stream.KEY, F.col("status") == "accepted")
    run = stream.gated(source, rule, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "at"))
    assert run.awaitTermination(120)
    assert sorted(r.compact_index for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [0, 1, 3]
    assert [r.rule for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["status"]


def test_logistic_optimum(spark):
    import random

    rng = random.Random(8)
    rows = [(i, i % 2, "train" if i < 120 else "val" if i < 160 else "test", [rng.gauss(i % 2, 1), rng.gauss(0, 1), 3.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, made int, split string, v array<double>")
    scaled = detector.scaled_vectors(df, ["id", "made", "split"], "v", "split = 'train'")
    assert all(abs(r.v[2]) < 1e-12 for r in scaled.collect())
    margins, c, tried = detector.logistic_grid(scaled, "v", "made = 1", "split", grid=(0.1, 1.0))
    assert c in (0.1, 1.0) and len(tried) == 2 and max(v for _, v in tried) == dict(tried)[c]
    assert margins.where("split = 'test' AND (score > 0) = (made = 1)").count() > 22


def test_logistic_grids_of_many_cells(spark, monkeypatch):
    """All cells at once: every fit is a minimum, cells don't touch each other, and cells that lack a class have no score."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(detector, "_HELD", 2)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        cell, made = i % 3, i // 3 % 2
        rows.append((i, f"cell{cell}", made, ("train", "train", "val")[i // 6 % 3], (rng.normal(size=4) + made * (0.5 + cell)).tolist()))
    rows += [(1000 + i, "one class", 1, ("train", "val")[i % 2], [1.0] * 4) for i in range(6)] + [(2000, None, 0, "train", [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, cell string, made int, split string, v array<double>").repartition(5)
    scored, tried = detector.logistic_grids(df, "cell", "v", "made = 1", "split", grid=(0.01, 1.0, 100.0))
    assert scored.columns == [*df.columns, "selected_c", "score"]
    got = {r.id: r for r in scored.collect()}
    assert len(got) == len(rows) and [(x, c) for x, c, _ in tried] == [(f"cell{k}", c) for k in range(3) for c in (0.01, 1.0, 100.0)]
    assert all(r.score is None and r.selected_c is None for r in got.values() if r.id >= 1000)
    for name in ("cell0", "cell1", "cell2"):
        held = {c: value for x, c, value in tried if x == name}
        own = [r for r in rows if r[1] == name]
        c = got[own[0][0]].selected_c
        assert c == min(k for k, v in held.items() if v == max(held.values()))
        val = [(got[r[0]].score, r[2]) for r in own if r[3] == "val"]
        pairs = [(a > b) + (a == b) / 2 for a, x in val if x for b, y in val if not y]
        assert abs(sum(pairs) / len(pairs) - held[c]) < 1e-12
        x = np.array([[*r[4], 1.0] for r in own])
        w = np.linalg.lstsq(x, np.array([got[r[0]].score for r in own]), rcond=None)[0]
        train = np.array([r[3] == "train" for r in own])
        y = np.array([r[2] for r in own])
        slope = x[train].T @ (1 / (1 + np.exp(-x[train] @ w)) - y[train]) + np.append(w[:-1], 0) / c
        assert np.abs(slope).max() / train.sum() < 1e-7
    data = df.where("cell = 'cell1' AND split = 'train'").select(array_to_vector("v").alias("features"), F.col("made").cast("double").alias("label"))
    _, c, _ = detector.logistic_grid(df.where("cell = 'cell1'"), "v", "made = 1", "split", grid=(1.0,))
    model = LogisticRegression(regParam=1 / (c * data.count()), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(data)
    alone = {r.id: r.score for r in detector.logistic_grid(df.where("cell = 'cell1'"), "v", "made = 1", "split", grid=(1.0,))[0].collect()}
    for r in [r for r in rows if r[1] == "cell1"][:20]:
        assert abs(float(np.dot(model.coefficients.toArray(), r[4]) + model.intercept) - alone[r[0]]) < 1e-4
