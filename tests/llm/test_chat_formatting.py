"""Tool-call linking against a plain Python version, schemas, and odd rows."""

from __future__ import annotations

import json
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sievemark.llm import chat_formatting as c
from sievemark.llm.queries import ORACLE_SQL, QUERIES

SCHEMAS = {
    "find": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string", "minLength": 1, "maxLength": 5}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "additionalProperties": False},
    "note": {"type": "object"},
}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, refs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def brute(calls, results):
    own, answers = {}, {}
    for r in sorted(calls, key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or "")):
        own.setdefault((r[0], r[1]), r)
    for r in sorted(results, key=lambda r: (r[2] is not None, r[2] or 0)):
        answers.setdefault((r[0], r[1]), r[3])
    level = {}
    while True:
        ready = {k: 1 + max((level[k[0], x] for x in r[5] or [] if (k[0], x) in own), default=-1) for k, r in own.items() if k not in level and all((k[0], x) in level for x in r[5] or [] if (k[0], x) in own)}
        if not ready:
            break
        level |= ready
    out = {}
    for conv in {k[0] for k in own}:
        ordered = sorted((k for k in level if k[0] == conv), key=lambda k: (level[k], own[k][2], k[1]))
        out |= {k: (level[k], i) for i, k in enumerate(ordered)}
    return own, answers, out


def test_links_levels_and_places(spark):
    rng = random.Random(4)
    calls, results = [], []
    for conv in range(6):
        n = 700 if conv == 0 else rng.randint(1, 9)
        for k in range(n):
            refs = [f"c{rng.randrange(k)}" for _ in range(rng.randint(0, 2))] if k and rng.random() < 0.5 and conv else []
            if rng.random() < 0.1:
                refs.append("nowhere")
            calls.append((conv, f"c{k}", k * 2, "note", json.dumps({"k": k, "a": [1.5, "ü"]}), refs))
            if rng.random() < 0.8:
                results.append((conv, f"c{k}", k * 2 + 1, f"r{k}"))
    calls += [(7, "x", 1, "note", "{}", ["y"]), (7, "y", 2, "note", "{}", ["x"]), (7, "z", 3, "note", "{}", ["x"]), (7, "free", 4, "note", "{}", None)]
    calls += [(8, "twice", 5, "note", '{"late":1}', []), (8, "twice", 2, "note", '{"early":1}', []), (8, "self", 1, "note", "{}", ["self"])]
    results += [(8, "twice", 9, "second"), (8, "twice", 3, "first"), (9, "none", 1, "lost")]
    got = c.link_calls(spark, spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame(results, RESULTS).repartition(3), SCHEMAS).collect()
    own, answers, places = brute(calls, results)
    assert len(got) == len(own) + sum(k not in own for k in answers)
    for r in got:
        key = (r.conv_id, r.call_id)
        if key not in own:
            assert r.status == "orphan"
            continue
        assert (r.level, r.place) == places.get(key, (None, None))
        line = json.loads(r.line)
        assert line["result"] == answers.get(key) and line["arguments"] == json.loads(own[key][4])
        assert r.line == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        bad = "nowhere" in (own[key][5] or [])
        assert r.status == ("cyclic" if key not in places else "invalid" if bad else "ok" if key in answers else "unanswered")


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Chains, chains behind calls of several references, behind circles, and soft references, against plain Python."""
    n = 1500
    calls = [(1, f"c{k}", k, "note", "{}", [f"c{k - 1}"] if k else []) for k in range(n)]
    calls += [(2, f"c{k}", k, "note", "{}", [f"c{k - 1}", f"c{k - 9}"] if k % 9 == 0 and k else [f"c{k - 1}"] if k else []) for k in range(40)]
    calls += [(3, "a", 1, "note", "{}", ["b"]), (3, "b", 2, "note", "{}", ["a"]), (3, "c", 3, "note", "{}", ["b"]), (3, "d", 4, "note", "{}", ["c", "e"]), (3, "e", 5, "note", "{}", []), (3, "f", 6, "note", "{}", ["d"]), (3, "g", 7, "note", "{}", ["e", "e"])]
    rounds = []
    kept = c.cut
    monkeypatch.setattr(c, "cut", lambda df: rounds.append(1) or kept(df))
    results = spark.createDataFrame([], RESULTS)
    got = c.link_calls(spark, spark.createDataFrame(calls, CALLS), results, SCHEMAS).collect()
    places = brute(calls, [])[2]
    assert {(r.conv_id, r.call_id): (r.level, r.place) for r in got} == {(x[0], x[1]): places.get((x[0], x[1]), (None, None)) for x in calls}
    assert max(r.level for r in got if r.conv_id == 1) == n - 1
    assert len(rounds) < 40
    soft = [(1, "x", 1, "note", "{}", [], "gone"), (1, "y", 2, "note", "{}", [], "x"), (1, "z", 3, "note", "{}", ["gone"], "y")]
    got = c.link_calls(spark, spark.createDataFrame(soft, CALLS + ", after string"), results, SCHEMAS).collect()
    assert {r.call_id: (r.level, r.place, r.status) for r in got} == {"x": (0, 0, "unanswered"), "y": (1, 1, "unanswered"), "z": (2, 2, "invalid")}


def test_schemas():
    schema = SCHEMAS["find"]
    assert c.problems_of({"q": "abc", "n": 3, "tags": ["a"]}, schema) == []
    assert c.problems_of({"q": "", "n": 10, "tags": ["c"], "z": 1}, schema) == ["$.n: maximum", "$.q: minLength", "$.tags[0]: enum", "$.z: unknown"]
    assert c.problems_of({"n": True}, schema) == ["$.q: required", "$.n: type"]
    assert c.problems_of([], schema) == ["$: type"]
    assert c.parsed('{"a": NaN}') == (None, False) and c.parsed(None) == (None, False)


def test_turns_with_tool_calls(spark):
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "find", "arguments": {"q": "x"}}, {"id": "b", "name": "find", "arguments": '{"q":1}', "refs": ["a"]}, {"name": "find"}]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"hits": [2, 1]}})),
        (None, 1, "user", None),
        (2, 0, "user", None),
        (2, 1, "assistant", "{not json"),
        (3, 5, "assistant", "alone"),
        (4, 0, "user", "again"),
        (4, 0, "user", "again"),
        (4, 1, "assistant", "w " * 100000),
        (5, None, None, None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1)).withColumn("level", F.lit("x")).withColumn("refs", F.lit(0))
    got = {(r.conv_id, r.call_id): r for r in c.format_turns(spark, turns, {**c.RESPOND, "find": SCHEMAS["find"]}).collect()}
    assert {k: r.status for k, r in got.items()} == {(1, "1:0"): "unanswered", (1, "a"): "ok", (1, "b"): "invalid", (1, None): "unlinked", (None, None): "unlinked", (2, "2:0"): "invalid", (3, "3:4"): "orphan", (4, "4:0"): "ok"}
    assert got[1, "a"].line == '{"arguments":{"q":"x"},"id":"a","name":"find","result":"{\\"hits\\":[2,1]}"}'
    assert got[1, "b"].problems == ["$.q: type"] and got[1, "b"].level == 1
    assert c.format_turns(spark, turns.where("conv_id = 99")).count() == 0


def said(rows):
    """Texts of turns, as many times as the rows hold them."""
    found = Counter()
    for r in rows:
        line = json.loads(r.line)
        if r.status == "message":
            found[line["content"]] += 1
        else:
            is_call = line["name"] == "respond"
            found[line["arguments"]["text"] if is_call else line["result"]] += r.copies
            if is_call and r.status != "duplicate" and line["result"] is not None:
                found[line["result"]] += 1
    return found


def test_no_turn_is_missing(spark, sf_dir):
    beside = json.dumps({"tool_calls": [{"id": "a", "name": "find"}], "content": "beside"})
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 1, "user", "other q"), (1, 2, "assistant", "r"), (1, 2, "assistant", "s"), (1, 2, "assistant", "s"), (2, 0, None, "no role"), (3, 0, "assistant", '{"tool_calls": []}'), (4, 5, "assistant", "alone"), (4, 5, "assistant", "alone"), (None, 0, "system", "lost")]
    schema = "conv_id long, turn long, role string, text string"
    got = c.format_turns(spark, spark.createDataFrame(rows, schema), whole=True).collect()
    assert said(got) == Counter(r[3] for r in rows)
    assert Counter(r.status for r in got) == {"message": 4, "ok": 1, "orphan": 1, "duplicate": 3}
    assert {(r.call_id, r.copies) for r in got if r.status == "duplicate"} == {("1:1", 2), ("4:4", 1)}
    mixed = c.format_turns(spark, spark.createDataFrame([(1, 0, "assistant", beside)], schema), whole=True).collect()
    assert {r.status for r in mixed} == {"invalid", "message"} and any(json.loads(r.line).get("content") == beside for r in mixed)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    table = QUERIES["op4_chat_whole"](spark, sf_dir)
    assert said(table.collect()) == Counter(r.text for r in turns.collect())


def test_whole_query_against_sql(spark, sf_dir, tmp_path):
    turns = duckdb.sql(f"SELECT * FROM '{sf_dir}/conversations.parquet' UNION ALL SELECT * FROM '{sf_dir}/conversations.parquet' WHERE conv_id % 3 = 0 UNION ALL SELECT * REPLACE ('~' || text AS text) FROM '{sf_dir}/conversations.parquet' WHERE conv_id % 4 = 0")
    turns.write_parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in QUERIES["op4_chat_whole"](spark, str(tmp_path)).collect()]
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert Counter(got) == Counter(engine.sql(ORACLE_SQL["op4_chat_whole"]).fetchall())
    assert any(r[5] == "duplicate" for r in got) and any(r[5] == "message" for r in got)
    assert any((r[3] or 0) > 1 for r in got)


def test_json_that_cannot_be_written_again(spark):
    texts = ['{"text":1e999}', '{"text":"\\ud800"}', '{"text":NaN}', "[" * 900 + "]" * 900, "[" * 50000 + "]" * 50000, '{"text":"\\ud83d\\ude00"}']
    for t in texts[:5]:
        assert c.parsed(t) == (None, False) or json.loads(c.canonical(c.parsed(t)[0])) == json.loads(t)
    assert c.parsed(texts[5]) == ({"text": "\U0001f600"}, True)
    calls = [{"tool_calls": [{"id": str(k), "name": "respond", "arguments": t}]} for k, t in enumerate(texts)]
    turns = [(1, k, "assistant", json.dumps(x)) for k, x in enumerate(calls)] + [(2, k, "user", t) for k, t in enumerate(texts)] + [(3, 0, "tool", '{"tool_call_id":"a","content":1e999}')]
    rows = c.format_turns(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), whole=True).collect()
    assert len(rows) >= len(turns)
    status = {(r.conv_id, r.call_id): (r.status, list(r.problems)) for r in rows}
    assert status[1, "0"] == status[1, "1"] == ("invalid", ["$: not JSON"]) and status[1, "5"][0] == "unanswered"
    for r in rows:
        json.loads(r.line)
