"""Whole-cell rules: each cell of one table breaks one rule by one changed field, and just that rule is told."""

from __future__ import annotations

import hashlib
import json

import pytest

from sievemark.operators import cells
from sievemark.sources.files import ENDPOINT

SPLITS = {"train": 2, "val": 1}
QUEUE = [("main", f"s{i}", i, f"h{i}", f"t{i}", "train" if i < 2 else "val", f"p{i}") for i in range(3)] + [("pilot", f"q{i}", i, f"h{i}", f"t{i}", "train", f"p{i}") for i in range(2)]
CONTRACT = ["suite", "cell", "run_id", "account_alias", "phase", "cohort", "config_sha256", "model_hf_id", "model_revision", "contract_sha256"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def contract(cell, **change):
    own = {"suite": "scale", "cell": cell, "run_id": "run", "account_alias": "a", "phase": "main", "cohort": "main", "config_sha256": "c", "model_hf_id": f"m/{cell}", "model_revision": "r"} | change
    return {"contract_sha256": sha(json.dumps(own, sort_keys=True, separators=(",", ":")))} | own | change


def endpoint(c, source, index, human, topic, split, prompt, **change):
    raw = f"  output  of {source}\n"
    own = {k: c[k] for k in ("contract_sha256", "run_id", "suite", "cell", "cohort", "phase", "model_hf_id", "model_revision")}
    own |= {"source_id": source, "human_sha256": human, "topic_sha256": topic, "compact_index": index, "split_origin": split, "attempt": 0, "status": "accepted", "output_tokens": 2, "output_token_ids": [1, 2], "exact_token_count": True}
    normal = " ".join(raw.split())
    own |= {"raw_output": raw, "normalized_output": normal, "raw_output_sha256": sha(raw), "normalized_output_sha256": sha(normal), "prompt_sha256": prompt, "actual_words": 3, "file": "attempt-00.json"}
    return own | change


def summary(c, n, **change):
    return {k: c[k] for k in ("suite", "cell", "run_id", "contract_sha256", "cohort", "phase")} | {"complete": True, "requested_sources": n, "completed_sources": n, "accepted_sources": n, "exhausted_sources": 0} | change


# what is changed: (table, changes of its first row), and the rules that then are broken
CASES = {
    "good": (None, {}, set()),
    "pilot": ("phase", {}, set()),
    **{f"contract {f}": ("contract", {f: "other"}, {f"contract/{f}"}) for f in ("run_id", "account_alias", "config_sha256", "model_hf_id", "model_revision")},
    "phase": ("contract", {"phase": "later", "cohort": "pilot"}, {"contract/phase"}),
    "cohort": ("contract", {"cohort": "pilot"}, {"contract/cohort"}),
    "own hash": ("contract", {"contract_sha256": "0"}, {"contract/own hash"}),
    "wanted phase": ("wanted", {"phase": "smoke"}, {"contract/phase wanted"}),
    "no wanted": ("wanted", None, {"contract/wanted", "contract/unexpected"}),
    "listed twice": ("listed", {"twice": True}, {"listed/unique", "listed/order", "completion/requested_sources", "completion/completed_sources", "completion/accepted_sources"}),
    "listed unknown": ("listed", {"source_id": "zz"}, {"listed/queued", "listed/order", "listed/main lacks", "endpoint/missing", "endpoint/not listed"}),
    "listed order": ("listed", {"swap": True}, {"listed/order"}),
    **{f"endpoint {f}": ("endpoint", {f: v}, {f"endpoint/{f}"}) for f, v in {"contract_sha256": "0", "run_id": "x", "cohort": "pilot", "phase": "smoke", "model_hf_id": None, "model_revision": "x", "human_sha256": "x", "topic_sha256": None, "compact_index": 9}.items()},
    "split": ("endpoint", {"split_origin": "val"}, {"endpoint/split_origin", "completion/splits"}),
    "attempt": ("endpoint", {"attempt": 1}, {"endpoint/attempt"}),
    "status": ("endpoint", {"status": None}, {"endpoint/status"}),
    "tokens": ("endpoint", {"output_tokens": 3}, {"endpoint/tokens"}),
    "token ids": ("endpoint", {"output_token_ids": [1]}, {"endpoint/token ids"}),
    "exact": ("endpoint", {"exact_token_count": False}, {"endpoint/exact"}),
    "empty": ("endpoint", {"raw_output": " ", "raw_output_sha256": sha(" "), "normalized_output": "", "normalized_output_sha256": sha("")}, {"endpoint/empty"}),
    "normal": ("endpoint", {"normalized_output": "output", "normalized_output_sha256": sha("output")}, {"endpoint/normal form"}),
    "raw hash": ("endpoint", {"raw_output_sha256": "0"}, {"endpoint/raw hash"}),
    "normal hash": ("endpoint", {"normalized_output_sha256": None}, {"endpoint/normal hash"}),
    "prompt": ("endpoint", {"prompt_sha256": "0"}, {"endpoint/prompt"}),
    "file": ("endpoint", {"file": "attempt-01.json"}, {"endpoint/sole attempt"}),
    "two files": ("endpoint", {"twice": True}, {"endpoint/sole attempt", "completion/splits"}),
    "gone": ("endpoint", None, {"endpoint/missing", "completion/splits"}),
    "not queued": ("endpoint", {"source_id": "zz"}, {"endpoint/queued", "endpoint/not listed", "endpoint/missing"}),
    **{f"summary {f}": ("summary", {f: v}, {f"completion/{f}"}) for f, v in {"run_id": "x", "contract_sha256": None, "cohort": "pilot", "phase": "smoke", "complete": False, "requested_sources": 2, "completed_sources": None, "accepted_sources": 4, "exhausted_sources": 1}.items()},
    "no summary": ("summary", None, {"completion/missing"}),
}


@pytest.fixture(scope="module")
def told(spark):
    contracts, wanted, listed, endpoints, summaries = [], [], [], [], []
    for cell, (where, change, _) in CASES.items():
        phase = {"phase": "pilot", "cohort": "pilot"} if where == "phase" else {}
        c = contract(cell, **phase, **(change if where == "contract" else {}))
        good = contract(cell)
        if not (where == "wanted" and change is None):
            wanted.append({k: good[k] for k in ("suite", "cell", "run_id", "account_alias", "config_sha256", "model_hf_id", "model_revision")} | {"phase": change.get("phase") if where == "wanted" else None})
        contracts.append(c)
        sources = [q for q in QUEUE if q[0] == ("pilot" if c["phase"] == "pilot" else "main")]
        ids = [q[1] for q in sources]
        if where == "listed":
            ids = [ids[0], *ids] if "twice" in change else [ids[1], ids[0], ids[2]] if "swap" in change else [change["source_id"], *ids[1:]]
        listed += [("scale", cell, k, i) for k, i in enumerate(ids)]
        for k, (_, source, *rest) in enumerate(sources):
            own = change if where == "endpoint" and k == 0 else {}
            if own is None:
                continue
            twice = own.get("twice")
            row = endpoint(c, source, *rest, **({} if twice else {x: v for x, v in own.items() if x != "source_id"}))
            endpoints += [row | ({"source_id": own["source_id"]} if "source_id" in own else {})] * (2 if twice else 1)
        if not (where == "summary" and change is None):
            summaries.append(summary(c, len(sources), **(change if where == "summary" else {})))
    frame = lambda rows, schema: spark.createDataFrame([tuple(r.get(x.split()[0]) for x in schema.split(", ")) for r in rows], schema)
    text = lambda names: ", ".join(f"{c} string" for c in names)
    made = cells.whole_cells(
        frame(endpoints, ENDPOINT + ", file string"),
        frame(contracts, text(CONTRACT)),
        frame(wanted, text([c for c in CONTRACT if c not in ("cohort", "contract_sha256")])),
        spark.createDataFrame(listed, "suite string, cell string, position int, source_id string"),
        spark.createDataFrame(QUEUE, "cohort string, source_id string, compact_index int, human_sha256 string, topic_sha256 string, split_origin string, prompt_sha256 string"),
        frame(summaries, text(["suite", "cell", "run_id", "contract_sha256", "cohort", "phase"]) + ", complete boolean, requested_sources int, completed_sources int, accepted_sources int, exhausted_sources int"),
        2,
        SPLITS,
    )
    found: dict[str, set[str]] = {c: set() for c in CASES}
    for r in made.collect():
        found[r.key.split("|")[1]].add(f"{r.gate}/{r.rule}")
    return found


@pytest.mark.parametrize("cell", CASES)
def test_just_the_changed_rule_is_told(told, cell):
    assert told[cell] == CASES[cell][2]


def test_panel(spark):
    rows = [contract("a"), contract("b"), contract("c", run_id="other")]
    ends = [endpoint(c, f"s{i}", i, f"h{i}", "t", "train", "p") for c in rows for i in range(2) if (c["cell"], i) != ("b", 1)]
    frame = lambda rows, names: spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} string" for c in names))
    wanted = spark.createDataFrame([("scale", "a"), ("scale", "b"), ("scale", "d")], "suite string, cell string")
    found = {(r.gate, r.rule, r.key) for r in cells.panel_rules(frame(ends, ["suite", "cell", "source_id", "human_sha256", "split_origin"]), frame(rows, CONTRACT), wanted).collect()}
    assert ("panel sources", "missing", "scale|b|s1") in found and ("panel contracts", "missing", "scale|d") in found and ("panel contracts", "unexpected", "scale|c") in found
    assert any(rule == "run_id" for _, rule, _ in found) and not any(rule == "config_sha256" for _, rule, _ in found)
