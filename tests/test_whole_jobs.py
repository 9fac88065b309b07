"""Registered queries over whole texts, all labels and full counts, on small tables, against brute force."""

from __future__ import annotations

import math

from sievemark.plans import catalogue as q


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_edit_similarity_of_whole_texts(spark, tmp_path):
    texts = [("a" * 300 + "tail", "a" * 300 + "other end"), ("déjà", "dèjà"), ("", ""), ("long " * 200, "long " * 199 + "lung "), ("x", "")]
    rows = [x for k, (a, b) in enumerate(texts) for x in ((k, 0, "user", a), (k, 1, "assistant", b))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.similarity for r in q.QUERIES["edit_similarity_whole"](spark, str(tmp_path)).collect()}
    for k, (a, b) in enumerate(texts):
        assert math.isclose(got[k], 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0, abs_tol=1e-9)
    assert got[0] < 1 and got[1] == 0.75


def test_qap_exact_relabels_all_labels(spark, sf_dir):
    assert q.QUERIES["qap_exact"](spark, sf_dir).first().total == math.factorial(10)


def test_detectors_score_every_row(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    every = {tuple(r) for r in vectors.collect()}
    for name in ("detector_scores_cells", "logistic_detector_grid"):
        got = q.QUERIES[name](spark, sf_dir).collect()
        assert len(got) == len(every) and {(r.vec_id, r.label) for r in got} == every
        assert all(r.score is not None and r.cell == r.label // 2 for r in got)
    got = q.QUERIES["detector_scores"](spark, sf_dir).collect()
    assert {(r.vec_id, r.label) for r in got} == every and len(got) == len(every)


def test_resampling_counts_are_those_of_the_reference(spark, sf_dir):
    assert q.REPLICATES == 10_000
    assert q.QUERIES["cluster_bootstrap_whole"](spark, sf_dir).first().replicates == 5_000
    assert q.QUERIES["qap_monte_carlo"](spark, sf_dir).first().total == 100_000
