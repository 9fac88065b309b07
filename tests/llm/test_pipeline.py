"""Every stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import corpus_pipeline as p
from brute import contamination, exact, mixing_targets, near

from sievemark.llm import toxicity as t


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    scores = {r.doc_id: r.toxic for r in t.toxicity(spark, docs, t.graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    expected = {i for i, _ in rows_of(docs) if not scores[i]}
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(p.STAGES):
        before = rows_of(docs)
        out = stage(spark, docs, sf_dir)
        if k == len(p.STAGES) - 1:
            size, target = mixing_targets([(r.doc_id, r.source, r.text) for r in docs.collect()])
            taken = dict.fromkeys(size, 0)
            source = {r.doc_id: r.source for r in docs.collect()}
            for r in out.collect():
                taken[source[r.doc_id]] += r.taken
            assert all(abs(taken[s] - target[s]) <= 1 for s in size)
            break
        assert out.columns == columns
        if name == "exact dedup":
            expected = {r[0] for r in exact(before) if r[3]}
        elif name == "n-gram Jaccard join":
            expected = {r[2] for r in near(before)}
        elif name == "benchmark decontamination":
            expected = {r[0] for r in contamination(before, benchmark) if not r[5]}
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert {i for i, _ in rows_of(docs)} == expected, name
    whole = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in whole} == expected
