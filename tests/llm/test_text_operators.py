"""The text operators against brute force, on the small tables and on a fixture of odd rows."""

from __future__ import annotations

import math
import pickle
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from brute import contamination as brute_contamination
from brute import exact, mixing_targets, near, stupid_backoff, substring, suffix
from pyspark.sql import functions as F

from sievemark.llm import bytescan, countmin
from sievemark.llm.decontamination import contamination, decontaminate, patterns_of
from sievemark.llm import exact_dedup as exact_module
from sievemark.llm.exact_dedup import exact_classes, exact_dedup
from sievemark.llm.lm_scoring import BACKOFF, ORDER, lm_scores
from sievemark.llm.mixing import mix
from sievemark.llm.near_dedup import near_classes, near_dedup
from sievemark.llm.substring_dedup import substring_dedup
from sievemark.llm.suffix_dedup import suffix_dedup

LONG = " ".join(f"word{k * 7919 % 4001}" for k in range(9000))
PASSAGE = " ".join(f"pass{k}" for k in range(120))
ODD = [
    (1, "one two three"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "One TWO three"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "start " + PASSAGE + " end of eight"),
    (9, "begin " + PASSAGE + " close of nine"),
    (10, "ÄÖ éa ñ ß " * 70),
    (11, "äö éa ñ ß " * 70),
    (12, "a b c d"),
    (13, "x"),
    (14, "ab " * 400),
    (15, "ab " * 401),
    (16, "A B C D"),
    (17, PASSAGE),
    (18, PASSAGE + " " + PASSAGE),
]
ITEMS = [(1, " ".join(PASSAGE.split()[10:40])), (2, "a b c"), (3, None), (4, ""), (5, "x"), (1, "ab"), (None, "one two three")]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table, [(r.doc_id, r.text) for r in table.collect()]


def frame(spark, rows):
    """Odd rows with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", F.lit("de").alias("lang"), F.lit(1).alias("tag"), F.lit("x").alias("owner"), F.lit(None).cast("string").alias("kept"), F.lit(2).alias("component"), F.lit(3).alias("id"))


REPEATED = [*ODD, ODD[5], ODD[5], ODD[1], (12, "a b c d")]
CASES = {
    "exact": (exact_classes, exact, ("doc_id", "keep_id", "group_size", "kept", "text_sha256"), REPEATED + [(None, "one two three"), (None, "only null")]),
    "near": (near_classes, near, ("doc_id", "n_shingles", "component_id"), [*REPEATED, (None, "one two three"), (None, None), (3, "one two three"), (19, "a b c d"), (19, LONG)]),
    "suffix": (suffix_dedup, suffix, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), [*REPEATED, (None, LONG), (None, "only null"), (-1, LONG)]),
    "substring": (substring_dedup, substring, ("doc_id", "n_words", "n_removed", "kept_sha256"), [*REPEATED, (18, "short"), (9, PASSAGE), (None, PASSAGE), (7, "x " + LONG)]),
}


@pytest.mark.parametrize("name", CASES)
def test_tables_match_brute_force(spark, documents, name):
    ours, brute, columns, _ = CASES[name]
    assert rows_of(ours(spark, documents[0]), *columns) == sorted(brute(documents[1]), key=repr)


@pytest.mark.parametrize("name", CASES)
def test_odd_rows_match_brute_force(spark, name):
    ours, brute, columns, rows = CASES[name]
    assert rows_of(ours(spark, frame(spark, rows)), *columns) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("name", CASES)
def test_empty_table(spark, name):
    ours, _, columns, _ = CASES[name]
    assert rows_of(ours(spark, spark.createDataFrame([], "doc_id long, text string")), *columns) == []


@pytest.mark.parametrize("hot", [3, 40])
def test_suffix_dedup_of_hot_anchors(spark, hot):
    """Passages of 300 to 700 bytes among different texts, and whole copies, with hardly any or some anchors hot."""
    draw = random.Random(hot)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(7))
    passages = [" ".join(word() for _ in range(n)) for n in (38, 46, 50, 52, 87)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(draw.randrange(60))) for _ in range(3)]
        rows.append((i, f"{parts[0]} {draw.choice(passages)} {parts[1]}{draw.choice(passages)}{parts[2]}"))
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(200, "ab " * 500), (201, "x" * 2000), (0, rows[3][1])]
    got = rows_of(suffix_dedup(spark, frame(spark, rows), hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(suffix(rows), key=repr)


def test_near_copies_of_copies(spark):
    """Stars, guests and cells: families whose copies differ by nothing up to a third, and mixtures of two families."""
    draw = random.Random(5)
    rows = []
    for family in range(6):
        base = [f"w{draw.randrange(900)}" for _ in range(60 + 40 * family)]
        other = [f"w{draw.randrange(900)}" for _ in range(40)]
        for _ in range(45):
            words = base[:]
            for _ in range(draw.randrange(1 + len(base) // 20)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(12 if draw.random() < 0.7 else 900)}"
            if draw.random() < 0.3:
                words += other[: draw.randrange(40)]
            rows.append((len(rows), " ".join(words)))
    assert rows_of(near_classes(spark, frame(spark, rows)), "doc_id", "n_shingles", "component_id") == sorted(near(rows), key=repr)


def test_near_dedup_of_repeated_ids(spark):
    rows = [*REPEATED, (1, "one two three four"), (None, "one two three"), (None, None)]
    kept = [(r.doc_id, r.text) for r in near_dedup(spark, frame(spark, rows)).collect()]
    assert sorted(i for i, _ in kept if i is not None) == sorted({i for i, _, c in near(rows) if i == c and i is not None})
    assert (1, "one two three four") in kept and kept.count((None, None)) == 1


def test_contamination(spark, documents, sf_dir):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert rows_of(contamination(spark, documents[0], benchmark), *columns) == sorted(brute_contamination(documents[1], items), key=repr)
    odd, odd_items = frame(spark, REPEATED), spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted(brute_contamination(REPEATED, ITEMS), key=repr)
    assert rows_of(contamination(spark, odd, odd_items), *columns) == expected
    assert rows_of(contamination(spark, odd, odd_items, part_bytes=40), *columns) == expected
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r[2] for r in rows_of(contamination(spark, odd, none), *columns))


def test_pattern_tables():
    """Shifts and buckets of packed tables against their definitions, and their size."""
    draw = random.Random(3)
    items = [(str(k), " ".join(f"w{draw.randrange(60)}" for _ in range(draw.randrange(30)))) for k in range(80)] + [("x", None), ("y", items_text := " ".join(f"w{k}" for k in range(20))), ("z", items_text)]
    for p in patterns_of(items, 13):
        want, found = {}, {}
        for name, text in items:
            words = (text or "").split()
            if min(13, len(words)) != p.words or not words:
                continue
            for i in range(len(words) - p.words + 1):
                own = words[i : i + p.words]
                found.setdefault(" ".join(own).encode(), set()).add(name)
                for j in range(p.longest):
                    block = tuple(own[j : j + p.block])
                    want[block] = min(want.get(block, p.longest), p.longest - 1 - j)
        assert {p.stream.text(f, p.words): set(p.names(k)) for k, f in enumerate(p.firsts)} == found
        assert len(p.firsts) == len(found) and len(p.keys) == len(want) and sorted(p.shifts.tolist()) == sorted(want.values())
    large = [(str(k), " ".join(f"w{draw.randrange(50000)}" for _ in range(200))) for k in range(1700)]
    text = sum(len(t) for _, t in large)
    assert text > 2_000_000 and len(pickle.dumps(patterns_of(large, 13))) < 12 * text


def test_mixing(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(i, t, [None, "b", "a", "Z"][i % 4]) for i, t in ODD] + [(6, LONG, "a")], "doc_id long, text string, source string")
    for df in (table, odd):
        rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
        size, target = mixing_targets(rows)
        source = {r[0]: r[1] for r in rows}
        got = mix(spark, df).collect()
        assert len(got) == len(rows)
        taken = dict.fromkeys(size, 0)
        for r in got:
            own = source[r.doc_id]
            assert r.source_size == size[own] and math.isclose(r.target, target[own], rel_tol=1e-9, abs_tol=1e-6)
            assert 0 <= r.taken <= 2 * r.size
            taken[own] += r.taken
        for s in size:
            assert abs(taken[s] - target[s]) <= 1, s
        assert rows_of(mix(spark, df.repartition(2)), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    assert mix(spark, spark.createDataFrame([], odd.schema)).count() == 0


@pytest.mark.parametrize("order", [ORDER, 3])
def test_lm_scores(spark, documents, order):
    for df, rows in (documents, (frame(spark, REPEATED), REPEATED)):
        got = {}
        for r in lm_scores(spark, df, order).collect():
            got.setdefault(r.doc_id, (r.n_words, r.n_unseen, r.log_score))
        for i, n, unseen, score in stupid_backoff(rows, order, BACKOFF, math.log):
            assert got[i][:2] == (n, unseen)
            assert (got[i][2] is None) == (score is None)
            assert score is None or math.isclose(got[i][2], score, rel_tol=1e-9)


def test_filters_keep_columns_and_clean_rows(spark):
    odd = frame(spark, ODD)
    for ours in (exact_dedup, near_dedup):
        kept = ours(spark, odd)
        assert kept.columns == odd.columns
    assert {r.doc_id for r in exact_dedup(spark, odd).collect()} == {r[0] for r in exact(ODD) if r[3]}
    twice = frame(spark, [*REPEATED, (None, "one two three"), (None, "only null"), (None, "ONLY null"), (12, "another text")])
    rows = [(r.doc_id, r.text) for r in exact_dedup(spark, twice).collect()]
    assert len(rows) == len({(i, (t or "").lower()) for i, t in rows})
    assert {(i, (t or "").lower()) for i, t in rows} == {(i, (t or "").lower()) for i, t in [r for r in REPEATED if exact(REPEATED)[REPEATED.index(r)][3]] + [(None, "only null"), (12, "another text")]}
    assert {r.doc_id for r in near_dedup(spark, odd).collect()} == {r[2] for r in near(ODD)}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    nobody = spark.createDataFrame([(None, PASSAGE), (None, "clean text here"), (7, PASSAGE), (7, "another clean text")], "doc_id long, text string")
    assert sorted(r.text for r in decontaminate(spark, nobody, items).collect()) == ["another clean text", "clean text here"]
    assert {r.doc_id for r in decontaminate(spark, odd, items).collect()} == {r[0] for r in brute_contamination(ODD, ITEMS) if not r[5]}


@pytest.mark.parametrize("chunks", [1, 7])
def test_substring_dedup_over_chunks(spark, monkeypatch, chunks):
    """Shared passages, copies and rows without a doc_id, with texts dealt over several chunks and windows over several owners."""
    draw = random.Random(chunks)
    passages = [" ".join(f"p{k}x{j}" for j in range(n)) for k, n in enumerate((12, 13, 14, 30, 80))]
    rows = []
    for i in range(200):
        own = [" ".join(f"w{draw.randrange(5000)}" for _ in range(draw.randrange(40))) for _ in range(2)]
        rows.append((i, f"{own[0]} {draw.choice(passages)} {own[1]} {draw.choice(passages)}"))
    rows += [(300 + i, rows[5][1]) for i in range(40)] + [(None, rows[3][1])] * 5
    size = sum(len(t) for _, t in rows)
    monkeypatch.setattr("sievemark.llm.substring_dedup.CHUNK_BYTES", -(-size // chunks))
    monkeypatch.setattr("sievemark.llm.substring_dedup.OWNER_BYTES", -(-size // (2 * chunks)))
    for given in (rows, rows + rows[:30] * 3):
        got = rows_of(substring_dedup(spark, frame(spark, given)), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(substring(given), key=repr)


def test_sketch_of_owners():
    """Owners of cell ranges add what chunks sketch: no key that occurs twice is missed, and few others are taken for one."""
    draw = np.random.default_rng(4)
    once, twice = np.split(draw.integers(0, 1 << 63, 30000, dtype=np.uint64), [29000])
    chunks = [np.concatenate((part, twice)) for part in np.array_split(once, 3)] + [np.repeat(once[:1], 5)]
    cells = countmin.growing_cells(1 << 20, 8)
    assert cells == 1 << 23
    asked = pa.concat_tables([countmin.questions(c, keys, cells, 2) for c, keys in enumerate(chunks)])
    owners = sorted(set(asked.column("owner").to_pylist()))
    assert owners == [0, 1]
    told = pa.concat_tables([countmin.answers(asked.filter(pc.equal(asked.column("owner"), o))) for o in owners])
    for c, keys in enumerate(chunks):
        mine = draw.permutation(keys)
        classes = countmin.classes(mine, told.filter(pc.equal(told.column("chunk"), c)), cells, 2)
        many = classes > 0
        true = np.isin(mine, twice) | (mine == once[0])
        assert many[true].all() and many[~true].mean() < 0.01 if (~true).any() else many.all()


def test_planes():
    for kind in ("<i4", "<i8", "<u4"):
        for values in (np.zeros(0, kind), np.arange(-3, 300).astype(kind)):
            assert (bytescan.unplanes(bytescan.planes(values), kind) == values).all()


@pytest.mark.parametrize("name", ["suffix", "substring", "near"])
def test_tables_of_short_texts_only(spark, name):
    """Chunks without a window ask owners of cells for nothing."""
    ours, brute, columns, _ = CASES[name]
    rows = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (None, "c")]
    assert rows_of(ours(spark, frame(spark, rows)), *columns) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("name", ["suffix", "substring"])
def test_a_document_a_chunk(spark, monkeypatch, name):
    """Chunks of one document, of which some are told windows that cover nothing of theirs."""
    ours, brute, columns, _ = CASES[name]
    monkeypatch.setattr(f"sievemark.llm.{name}_dedup.CHUNK_BYTES", 300)
    rows = [(i, f"a{i} {PASSAGE if i % 3 else ''} b{i} " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(12)]
    assert rows_of(ours(spark, frame(spark, rows)), *columns) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("most", [1 << 19, 900])
def test_a_partition_sends_an_owner_one_message_a_turn(spark, monkeypatch, most):
    """Messages are counted by partitions and owners, not by the batches that a partition is read in."""
    monkeypatch.setattr(exact_module, "MESSAGE_KEYS", most)
    partitions, owners, n = 3, 5, 6000
    docs = spark.range(n, numPartitions=partitions).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id") % 4000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        sent = docs.mapInArrow(lambda batches: exact_module._ledger(batches, owners, most), exact_module._LEDGER).collect()
        turns = 1 if most > n else -(-(n // partitions) // most)
        assert len(sent) == partitions * owners * turns and len({(r.owner, r.sender) for r in sent}) == len(sent)
        assert sorted(i for r in sent for i in r.doc_ids) == list(range(n))
        for r in sent:
            values = exact_module.golomb_decode(bytes(r.coded), r.n, r.rice)
            assert len(values) == r.n and max(r.places) == r.n - 1 and len(r.shas) == len(r.places) == len(r.marked)
        rows = {r.doc_id: (r.keep_id, r.group_size) for r in exact_classes(spark, docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows == {i: (i % 4000 + 4000, 2) if i % 4000 < 2000 else (i, 1) for i in range(n)}
