"""Contracts, frozen ids, rewrite cells, completions, bindings, bootstraps of pairs: each rule by a changed field."""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pytest

from sievemark.operators import bootstrap, cluster, contracts, gates, page, qap
from sievemark.sources import files


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def found(df):
    return sorted({(r.rule, r.key) for r in df.collect()})


CELL = "suite string, cell string, "
ENDPOINT = CELL + (
    "source_id string, contract_sha256 string, run_id string, cohort string, phase string, model_hf_id string, model_revision string, human_sha256 string, topic_sha256 string, compact_index int, split_origin string,"
    " prompt_sha256 string, attempt int, status string, output_tokens int, output_token_ids array<int>, exact_token_count boolean, raw_output string, normalized_output string, raw_output_sha256 string, normalized_output_sha256 string"
)


def endpoint(k, **changed):
    raw = f"some  output {k}"
    normal = f"some output {k}"
    row = {
        "suite": "tulu", "cell": "base", "source_id": f"s{k}", "contract_sha256": "c", "run_id": "r", "cohort": "main", "phase": "main", "model_hf_id": "m", "model_revision": "v",
        "human_sha256": f"h{k}", "topic_sha256": f"t{k}", "compact_index": k, "split_origin": "train", "prompt_sha256": f"p{k}", "attempt": 0, "status": "accepted", "output_tokens": 2,
        "output_token_ids": [1, 2], "exact_token_count": True, "raw_output": raw, "normalized_output": normal, "raw_output_sha256": sha(raw), "normalized_output_sha256": sha(normal),
    }
    return tuple((row | changed).values())


def test_rewrite_cell(spark):
    contract = spark.createDataFrame([("tulu", "base", "c", "r", "main", "main", "m", "v")], CELL + "contract_sha256 string, run_id string, cohort string, phase string, model_hf_id string, model_revision string")
    queued = spark.createDataFrame([(f"s{k}", f"h{k}", f"t{k}", k, "train", f"p{k}") for k in range(20)], "source_id string, human_sha256 string, topic_sha256 string, compact_index int, split_origin string, prompt_sha256 string")
    assert found(contracts.rewrite_cell(spark.createDataFrame([endpoint(k) for k in range(5)], ENDPOINT), queued, contract, 2)) == []
    changes = [
        ({"contract_sha256": "x"}, "fields"), ({"run_id": None}, "fields"), ({"phase": "pilot"}, "fields"), ({"human_sha256": "x"}, "fields"), ({"prompt_sha256": "x"}, "fields"), ({"split_origin": "test"}, "fields"),
        ({"source_id": "nobody"}, "partner"), ({"attempt": 1}, "sole attempt"), ({"status": "rejected"}, "sole attempt"), ({"output_tokens": 3}, "tokens"), ({"output_token_ids": [1]}, "tokens"),
        ({"exact_token_count": False}, "tokens"), ({"normalized_output": "", "normalized_output_sha256": sha("")}, "output"), ({"raw_output_sha256": "x"}, "sha256 of raw_output"), ({"normalized_output_sha256": None}, "sha256 of normalized_output"),
    ]
    rows = [endpoint(k, **c) for k, (c, _) in enumerate(changes)]
    rules = {(r.rule, r.key.split("|")[-1]) for r in contracts.rewrite_cell(spark.createDataFrame(rows, ENDPOINT), queued, contract, 2).collect()}
    for k, (c, rule) in enumerate(changes):
        key = c.get("source_id", f"s{k}")
        assert (rule, key) in rules or (rule, "base") in rules, c
    twice = spark.createDataFrame([endpoint(1), endpoint(1)], ENDPOINT)
    assert found(contracts.rewrite_cell(twice, queued, contract, 2)) == [("unique", "tulu|base|s1")]


def test_contract_rows(spark):
    fields = ["run_id", "task", "account_alias", "queue_sha256", "prompt_contract_sha256", "config_sha256", "model_hf_id", "model_revision"]
    schema = CELL + ", ".join(f"{f} string" for f in fields)
    wanted = spark.createDataFrame([("tulu", c, *fields) for c in ("base", "sft")], schema)

    def made(**changed):
        row = {"suite": "tulu", "cell": "base", **{f: f for f in fields}, "phase": "main", "cohort": "main"} | changed
        own = changed.get("contract_sha256") or sha(json.dumps({k: row[k] for k in sorted(row) if k != "contract_sha256"}, separators=(",", ":")))
        return {**row, "contract_sha256": own}

    def rules(*rows):
        return found(contracts.contract_rows(spark.createDataFrame([tuple(r.values()) for r in rows], schema + ", phase string, cohort string, contract_sha256 string"), wanted))

    good = (made(), made(cell="sft", phase="pilot", cohort="pilot"))
    assert rules(*good) == []
    assert rules(good[0]) == [("missing", "tulu|sft")]
    assert rules(*good, made(cell="other")) == [("partner", "tulu|other"), ("unexpected", "tulu|other")]
    for f in fields:
        assert rules(made(**{f: "x"}), good[1]) == [("fields", "tulu|base")]
    assert rules(made(contract_sha256="0"), good[1]) == [("own hash", "tulu|base")]
    assert rules(made(cohort="pilot"), good[1]) == [("cohort", "tulu|base")]
    assert rules(made(phase="late", cohort="pilot"), good[1]) == [("phase", "tulu|base")]


def test_frozen_ids_and_completion(spark):
    queue = spark.createDataFrame([(c, k, f"{c}{k}") for c in ("main", "pilot") for k in range(6)], "cohort string, position int, source_id string")
    schema = CELL + "phase string, position int, source_id string"
    counts = {"smoke": 2, "pilot": 4, "main": 6}
    rows = [("t", "a", "main", k, f"main{k}") for k in range(6)] + [("t", "b", "smoke", k, f"pilot{k}") for k in range(2)]
    assert found(contracts.frozen_ids(spark.createDataFrame(rows, schema), queue, counts)) == []
    swapped = [("t", "a", "main", {0: 1, 1: 0}.get(r[3], r[3]), r[4]) if r[1] == "a" else r for r in rows]
    assert found(contracts.frozen_ids(spark.createDataFrame(swapped, schema), queue, counts)) == [("order", "t|a|0"), ("order", "t|a|1")]
    assert found(contracts.frozen_ids(spark.createDataFrame(rows[:-1], schema), queue, counts)) == [("order", "t|b|1")]
    longer = [*rows, ("t", "b", "smoke", 2, "pilot2")]
    assert found(contracts.frozen_ids(spark.createDataFrame(longer, schema), queue, counts)) == [("order", "t|b|2")]

    done = "suite string, cell string, contract_sha256 string, cohort string, phase string, complete boolean, requested_sources int, completed_sources int, accepted_sources int, exhausted_sources int"
    contract = spark.createDataFrame([("tulu", "base", "c", "main", "main")], CELL + "contract_sha256 string, cohort string, phase string")
    ends = spark.createDataFrame([endpoint(k, split_origin="train" if k < 2 else "val") for k in range(3)], ENDPOINT)
    good = ("tulu", "base", "c", "main", "main", True, 3, 3, 3, 0)
    splits = {"train": 2, "val": 1}
    assert found(contracts.completion(spark.createDataFrame([good], done), contract, ends, splits)) == []
    for k, v in ((5, False), (6, 4), (7, 2), (8, 2), (9, 1)):
        bad = (*good[:k], v, *good[k + 1 :])
        assert found(contracts.completion(spark.createDataFrame([bad], done), contract, ends, splits)) == [("full acceptance", "tulu|base")]
    assert found(contracts.completion(spark.createDataFrame([(*good[:2], "x", *good[3:])], done), contract, ends, splits)) == [("fields", "tulu|base")]
    assert found(contracts.completion(spark.createDataFrame([good], done), contract, ends, {"train": 1, "val": 1})) == [("splits", "tulu|base|train")]


def test_fingerprints_and_results(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("a = 1\n")
    now = contracts.fingerprint(spark, files.file_digests(spark, str(tmp_path / "code")), ["pyspark", "no-such-package"])
    rows = {r.path: r.digest for r in now.collect()}
    assert rows["a.py"] == sha("a = 1\n") and rows["package:pyspark"] and rows["package:no-such-package"] is None
    lock = spark.createDataFrame([("a.py", "0"), ("package:pyspark", rows["package:pyspark"]), ("b.py", "1"), ("package:no-such-package", "1.0")], "path string, digest string")
    assert found(gates.locked(now, lock)) == [("fields", "a.py"), ("fields", "package:no-such-package"), ("missing", "b.py")]
    files.write_result(spark.createDataFrame([(0.5, None, ["x"])], "auroc double, p double, cells array<string>"), str(tmp_path / "result"))
    result = files.read_parameters(spark, str(tmp_path / "result"))
    assert result == {"auroc": 0.5, "p": None, "cells": ["x"]}
    assert files.first_present({"a": {"b": 3}}, "a.c", "a.b") == 3
    with pytest.raises(KeyError):
        files.first_present({"a": 1}, "a.b", "c")


def test_qap_moments_and_refusal(spark):
    rng = np.random.default_rng(3)
    n = 5
    predictor, target = rng.integers(0, 9, (n, n)).astype(float), rng.random((n, n))
    symmetric = predictor + predictor.T
    ranks = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    def matrix(p):
        return spark.createDataFrame([(i, j, float(p[i, j]), float(target[i, j])) for i in range(n) for j in range(n) if i != j], "i long, j long, predictor double, target double")

    for which, p in (("upper", symmetric), ("lower", symmetric), ("ordered", predictor)):
        chosen = [(i, j) for i in range(n) for j in range(n) if (i < j if which == "upper" else i > j if which == "lower" else i != j)]
        y = ranks(np.array([target[c] for c in chosen]))
        null = np.array([np.corrcoef(ranks(np.array([p[s[i], s[j]] for i, j in chosen])), y)[0, 1] for s in itertools.permutations(range(n))])
        r = qap.qap_exact(matrix(p), n, which).first()
        assert abs(r.rho - null[0]) < 1e-9 and r["count"] == (null >= null[0] - 1e-9).sum() and r.total == 120
        assert np.allclose([r.null_mean, r.null_sd, r.null_q95, r.null_q99], [null.mean(), null.std(), np.quantile(null, 0.95), np.quantile(null, 0.99)])
    for which in ("upper", "lower"):
        with pytest.raises(ValueError, match="symmetric"):
            qap.qap_exact(matrix(predictor), n, which)


def test_group_bootstrap(spark):
    rows = [(g, k, (k * 7) % 11, (k * k) % 13) for g in ("a", "b") for k in range(12 if g == "a" else 5)]
    out = cluster.group_bootstrap(spark.createDataFrame(rows, "g string, k long, x long, y long"), ["g"], ["k"], "x", "y", 40, 9).collect()
    ranks = lambda x: np.array([2 * (x < v).sum() + (x == v).sum() + 1 for v in x])
    for r in out:
        own = np.array([(x, y) for g, _, x, y in rows if g == r.g])
        assert r.pairs == len(own) and abs(r.rho - np.corrcoef(ranks(own[:, 0]), ranks(own[:, 1]))[0, 1]) < 1e-9
        rhos = []
        for rep in range(40):
            at = [int(hashlib.md5(f"9|{r.g}|{rep}|{d}".encode()).hexdigest()[:15], 16) % len(own) for d in range(len(own))]
            x, y = ranks(own[at, 0]), ranks(own[at, 1])
            if x.std() and y.std():
                rhos.append(np.corrcoef(x, y)[0, 1])
        assert np.allclose([r.ci_low, r.ci_high], np.quantile(rhos, [0.025, 0.975]))
    places = {r.k: r.place for r in bootstrap.numbered(spark.createDataFrame([(v,) for v in (9, 4, 4, 7, 1)], "k long"), "k").collect()}
    assert places == {1: 0, 4: 1, 7: 2, 9: 3}


def test_verdicts(spark):
    tests = spark.createDataFrame([(k, d, p) for k, d, p in (("a", "increasing", 0.01), ("b", "increasing", 0.2), ("c", "decreasing", 0.01), ("d", "increasing", 0.01), ("e", "increasing", 0.01), ("f", "increasing", 0.9))], "suite string, direction string, p double")
    audits = spark.createDataFrame([(k, a, d, s) for k, a, d, s in (("a", "NO_AMBIGUOUS", "", ""), ("b", "NO_AMBIGUOUS", "", ""), ("c", "NO_AMBIGUOUS", "", ""), ("d", "WITHHELD", "", ""), ("e", "ROBUST", "increasing", "false"), ("f", "ROBUST", "increasing", "true"))], "suite string, audit string, directions string, decisions string")
    got = {r.suite: r.verdict for r in page.verdict(tests, audits, "suite").collect()}
    yes, no = "DIRECTIONAL_SUPPORTED", "DIRECTIONAL_NOT_SUPPORTED"
    assert got == {"a": yes, "b": no, "c": no, "d": "WITHHELD_CEILING", "e": no, "f": yes}


def test_finite(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, None), (5, -1e300)], "k int, v double")
    kept, rejected = contracts.finite(rows, "g", ["k"], ["v"])
    assert sorted(r.k for r in kept.collect()) == [1, 5] and [r.key for r in rejected.orderBy("key").collect()] == ["2", "3", "4"]
