"""Severity model: held-out accuracy, graded labels, gradients, and odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sievemark.llm import toxicity as t


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = t.graded_labels(spark.read.parquet(f"{base}/labels.parquet"))
    half = F.pmod(F.hash("doc_id"), F.lit(2)) == 0
    rows = t.toxicity(spark, docs.join(labels, "doc_id", "left_semi"), labels.where(half)).join(labels.where(~half), "doc_id").collect()
    toxic = [r for r in rows if r.grade > 0]
    clean = [r for r in rows if r.grade == 0]
    assert len(toxic) > 100 and len(clean) > 1000
    assert sum(r.toxic for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert np.mean([r.severity for r in toxic]) > 0.7 > 0.1 > np.mean([r.severity for r in clean])


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    scores, grades, thresholds = rng.normal(size=50), rng.integers(0, 4, 50), np.array([-0.5, 0.4, 1.1])
    _, by_score, by_threshold = t.likelihood(scores, grades, thresholds)
    for i in range(3):
        up = np.eye(3)[i] * 1e-6
        numeric = (t.likelihood(scores, grades, thresholds + up)[0] - t.likelihood(scores, grades, thresholds - up)[0]) / 2e-6
        assert abs(numeric - by_threshold[i]) < 1e-4
    step = np.zeros(50)
    step[7] = 1e-6
    numeric = (t.likelihood(scores + step, grades, thresholds)[0] - t.likelihood(scores - step, grades, thresholds)[0]) / 2e-6
    assert abs(numeric - by_score[7]) < 1e-4


def test_grades_share_weights_over_thresholds(spark):
    """More marked words mean a higher grade; severity has to follow, beyond the rows it was fitted on."""
    rng = np.random.default_rng(2)

    def text(grade):
        words = [f"plain{rng.integers(300)}" for _ in range(40)] + [f"vile{k}" for k in rng.permutation(9)[: 3 * grade]]
        return " ".join(rng.permutation(words))

    rows = [(i, text(i % 4), i % 4) for i in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 600], "doc_id long, grade int")
    got = {r.doc_id: r for r in t.toxicity(spark, docs, labels).collect()}
    model = t.train(docs, labels)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    error = [abs(got[i].severity - grade) for i, _, grade in rows[600:]]
    assert np.mean(error) < 0.35 and all(got[i].toxic == (grade > 0) for i, _, grade in rows[600:])


def test_odd_rows(spark):
    rows = [(1, "you vile scum"), (2, "a fine day"), (3, None), (4, ""), (None, "vile"), (1, "you vile scum"), (5, "word " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p_toxic", F.lit("x")).withColumn("grade", F.lit(1)).withColumn("labelled", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, grade int")
    out = t.toxicity(spark, docs, labels).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 1, 2, 3, 4, 5]
    assert all(0 <= r.p_toxic <= 1 for r in out)
    nothing = labels.where("grade = 7")
    assert not any(r.toxic or r.severity for r in t.toxicity(spark, docs, nothing).collect())
    assert t.reject_toxic(spark, docs, nothing).count() == len(rows)
    assert t.reject_toxic(spark, docs, nothing).columns == docs.columns
    empty = docs.where("doc_id = 99")
    assert t.toxicity(spark, empty, labels).count() == 0


def test_a_repeated_doc_id_counts_once_in_the_fit(spark):
    """However often ``documents`` has a labelled doc_id, and with whatever texts, the fit sees one of its texts."""
    rows = [(1, "you vile scum")] * 40 + [(1, None), (1, "another vile text"), (2, "a fine day"), (3, "")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, grade int")
    texts = [None, "you vile scum", "another vile text"]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        sample = t.fit_sample(docs, labels).collect()
        assert sorted(r.grade for r in sample) == [0, 0, 1]
        own = {bytes(r.features) for x in texts for r in t.fit_sample(spark.createDataFrame([(1, x)], docs.schema), labels).collect()}
        assert [bytes(r.features) for r in sample if r.grade == 1] == [max(own)]


def test_every_feature_that_passes_the_test_is_kept():
    """20,000 features that each tell the classes apart: no number of them is too many."""
    shared = np.arange(20000)
    features = [shared if k % 2 else np.array([30000 + k]) for k in range(60)]
    model = t.fit(features, np.array([k % 2 for k in range(60)]), steps=2)
    assert set(shared.tolist()) <= set(model.features.tolist())
