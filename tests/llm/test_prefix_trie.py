"""The prefix trie against brute force, on the small tables and on odd, long, copied and one-sided conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sievemark.llm import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows (conv_id, turn, role, text) to the nodes of the contract."""

    def order(r):
        _, turn, role, text = r
        digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
        return (turn is not None, turn or 0, digest)

    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(x, key=order)] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[c][h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def result(spark, df):
    return sorted((tuple(r) for r in trie.prefix_trie(spark, df).select(*COLUMNS).collect()), key=repr)


def test_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert result(spark, df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def shape(kind, seed=5):
    rnd = random.Random(seed)
    if kind == "odd":
        rows = [(1, None, None, None), (1, 1, "user", None), (1, 1, "user", None), (1, 1, None, "ü"), (2, 3, "", ""), (None, 1, "user", "lost"), (-7, 0, "user", "minus"), (-5, 0, "user", "minus"), (-9, 2, "user", "x"), (0, 0, "user", "é" * 50_000), (7, 0, "a", "bc"), (8, 0, "ab", "c")]
        return rows + rows[:3] + [(c, t, "user", "same") for c in (20, 21, 22, 23, 24) for t in (4, 4, 5)]
    if kind == "random":
        return [(c, t, rnd.choice("ua"), rnd.choice("xyz") * rnd.randint(1, 2)) for c in range(-60, 140) for t in range(rnd.choice([1, 2, 5, 14]))]
    if kind == "copies":
        return [(c, t, "user", f"t{t}") for c in range(0, 400) for t in range(6)] + [(1000 + c, t, "user", "first" if t == 0 else f"{c}.{t}") for c in range(100) for t in range(12)]
    if kind == "comb":  # each conversation leaves the one before it a turn later
        return [(5 * k, t, "user", f"m{t}" if t < 10 + k else f"{k}.{t}") for k in range(40) for t in range(12 + k)]
    return [(5, t, "user", str(t)) for t in range(700)] + [(10, t, "user", str(t) if t < 500 else "z") for t in range(560)] + [(k, t, "user", f"{k % 3}") for k in range(15, 60, 5) for t in range(k)]


@pytest.mark.parametrize(("kind", "block"), [("odd", trie.BLOCK), ("copies", trie.BLOCK), ("random", 4), ("comb", 8), ("long", trie.BLOCK), ("long", 8)])
def test_shapes(spark, kind, block, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = shape(kind)
    assert result(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)) == brute(rows)


def test_packs_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)
    rows = [(c, 0, "user", "one") for c in [*range(-40, 300, 2), 9_000_000_000]]
    assert result(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == brute(rows)


def test_empty_and_other_columns(spark):
    schema = "conv_id long, turn long, role string, text string, depth int, place string, p long, n_bytes int"
    assert result(spark, spark.createDataFrame([], schema)) == []
    rows = [(1, 0, "user", "hello", 7, "p", 1, 2), (6, 0, "user", "hello", 7, None, 1, 2)]
    assert result(spark, spark.createDataFrame(rows, schema)) == brute([r[:4] for r in rows])
