"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

A document's features are binary: its distinct words (runs of digits, a-z after lower-casing A-Z, and non-ASCII
characters), the first 4 to 8 bytes of its words, and each of these again where it occurs 2, 3 or 5 times (a stem
that a clean text holds once by chance), hashed to ``DIMENSIONS`` places. The model has one weight
for each feature, shared by all thresholds: P(grade > k) = sigmoid(w.x - b_k) with b_0 < b_1 < ..., so the expected
severity is the sum of these probabilities. A document is toxic when P(grade > 0) is ``REJECT`` or more.

The fit uses a bounded sample of labelled rows: of each grade about ``FIT_ROWS`` doc_ids, those of the smallest hashes.
Sampled ids are few by construction and are broadcast to pick texts; executors send each sampled
document's features, four bytes each, to the driver. A sampled doc_id counts once, however often ``documents`` has it:
of its texts the one whose features come last as bytes. Features kept are all those whose presence goes with toxicity
by a chi-square test; the penalised likelihood is then maximised by adaptive gradient steps.
Scoring is one narrow pass over the documents: no shuffle and no join.

A null or empty text has no features and so the intercepts' score. Repeated rows are scored alike. Labels: a null
grade is left out; of repeated labels the highest grade counts. Without labels of both a zero and a positive grade nothing can be
learnt: severity is then 0 for all, and no document is toxic. Columns other than doc_id and text are ignored, but
kept by ``reject_toxic``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs

DIMENSIONS = 1 << 20
PREFIX_BYTES = (4, 5, 6, 7, 8)
#: A word or prefix is a further feature where it occurs so often.
REPEATS = (2, 3, 5)
#: Labelled rows of each grade that the fit uses, about.
FIT_ROWS = 2500
#: The 0.999 quantile of chi-square with one degree of freedom.
CHI_SQUARE = 10.83
PENALTY = 0.1
STEPS = 1000
REJECT = 0.5


def document_features(data: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a slice, each once, by text; ``wanted`` marks the features to return (``wanted_places``)."""
    data = bs.LOWER[data]
    a, b = bs.word_bounds(data, bs.LETTER_WORDS)
    owner = bs.documents_of(starts, a)
    keys, docs = [], []
    for salt, length in enumerate((None, *PREFIX_BYTES)):
        long = np.arange(len(a)) if length is None else np.flatnonzero(b - a > length)
        end = b[long] if length is None else a[long] + length
        keys.append(((bs.mix(bs.span_hashes(data, a[long], end) + np.uint64(salt)) >> np.uint64(20)) & np.uint64(DIMENSIONS - 1)).astype(np.int64))
        docs.append(owner[long])
    key, doc = np.concatenate(keys), np.concatenate(docs)
    if wanted is not None:
        near = np.flatnonzero(wanted.any(axis=0)[key])
        key, doc = key[near], doc[near]
    pairs, counts = np.unique(doc * DIMENSIONS + key, return_counts=True)
    levels = [pairs]
    for level, least in enumerate(REPEATS, 1):
        levels.append(level_places(pairs[counts >= least], level))
    pairs = np.unique(np.concatenate(levels))
    doc, key = pairs // DIMENSIONS, pairs % DIMENSIONS
    if wanted is not None:
        hit = np.flatnonzero(wanted[0][key])
        doc, key = doc[hit], key[hit]
    return doc, key


def level_places(pairs: np.ndarray, level: int) -> np.ndarray:
    """Places of the features that tell that others occur often: a bijection of the places for each level."""
    return pairs // DIMENSIONS * DIMENSIONS + (pairs % DIMENSIONS * (2 * level + 1) + level * 0x9E37) % DIMENSIONS


def wanted_places(features: np.ndarray) -> np.ndarray:
    """Row 0 marks ``features``; row k marks the places whose level-k feature is one of them."""
    every = np.arange(DIMENSIONS)
    own = np.zeros(DIMENSIONS, dtype=bool)
    own[features] = True
    return np.stack([own, *(own[level_places(every, level)] for level in range(1, len(REPEATS) + 1))])


@dataclass
class SeverityModel:
    """Shared weights of the kept features, and the ascending thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) of every text, one column for each threshold."""
        dense = np.zeros(DIMENSIONS)
        dense[self.features] = self.weights
        wanted = wanted_places(self.features)
        scores = np.zeros(len(column))
        for row, data, starts in bs.slices(column):
            doc, key = document_features(data, starts, wanted)
            scores[row : row + len(starts) - 1] = np.bincount(doc, weights=dense[key], minlength=len(starts) - 1)
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def likelihood(scores: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of grades, and its gradients by scores and by thresholds.

    P(grade = k) = s(k-1) - s(k) with s(k) = P(grade > k), s(-1) = 1 and s(last) = 0.
    """
    n, k = len(scores), len(thresholds)
    above = np.concatenate((np.ones((n, 1)), sigmoid(scores[:, None] - thresholds[None, :]), np.zeros((n, 1))), axis=1)
    slope = above * (1 - above)
    rows = np.arange(n)
    high, low = above[rows, grades], above[rows, grades + 1]
    p = np.maximum(high - low, 1e-12)
    d_high, d_low = slope[rows, grades] / p, slope[rows, grades + 1] / p
    by_threshold = np.zeros(k)
    np.add.at(by_threshold, grades[grades > 0] - 1, d_high[grades > 0])
    np.add.at(by_threshold, grades[grades < k], -d_low[grades < k])
    return float(-np.log(p).sum()), d_low - d_high, by_threshold


def fit(features: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> SeverityModel:
    """Select features and fit weights and thresholds; ``features`` has each document's distinct features."""
    classes = int(grades.max()) + 1 if len(grades) else 0
    if classes < 2 or not (grades == 0).any():
        return SeverityModel(np.zeros(0, np.int64), np.zeros(0), np.full(max(classes - 1, 1), np.inf))
    sizes = np.array([len(x) for x in features])
    column = np.concatenate(features) if len(features) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(features)), sizes)
    toxic = grades > 0
    in_toxic = np.bincount(column, weights=toxic[row], minlength=DIMENSIONS)
    in_all = np.bincount(column, minlength=DIMENSIONS).astype(float)
    n, t = float(len(grades)), float(toxic.sum())
    expected = in_all * t / n
    spread = np.maximum(expected * (1 - t / n) * (1 - in_all / n), 1e-9)
    chi = np.where((in_all >= 3) & (in_all < n), (in_toxic - expected) ** 2 / spread, 0.0)
    kept = np.flatnonzero(chi >= CHI_SQUARE)
    place = np.full(DIMENSIONS, -1)
    place[kept] = np.arange(len(kept))
    use = place[column] >= 0
    row, column = row[use], place[column[use]]
    share = np.array([(grades > k).mean() for k in range(classes - 1)])
    share = np.clip(share, 1 / (n + 2), 1 - 1 / (n + 2))
    weights, base = np.zeros(len(kept)), np.log(1 / share - 1)
    # thresholds are the first one and positive steps, kept apart by their logarithms
    gaps = np.log(np.maximum(np.diff(base), 0.1))
    theta = np.concatenate((weights, base[:1], gaps))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    m = len(kept)
    for step in range(1, steps + 1):
        weights, steps_up = theta[:m], np.exp(theta[m + 1 :])
        thresholds = theta[m] + np.concatenate(([0.0], np.cumsum(steps_up)))
        scores = np.bincount(row, weights=weights[column], minlength=len(grades))
        _, by_score, by_threshold = likelihood(scores, grades, thresholds)
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate((np.bincount(column, weights=by_score[row], minlength=m) + penalty * weights, tail[:1], tail[1:] * steps_up))
        if np.abs(gradient).max() < 1e-4:
            break
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    thresholds = theta[m] + np.concatenate(([0.0], np.cumsum(np.exp(theta[m + 1 :]))))
    return SeverityModel(kept, theta[:m], thresholds)


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(grade, features) of the sampled labelled documents; features are packed four-byte integers."""
    graded = labels.where("doc_id IS NOT NULL AND grade >= 0").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "grade int, features binary")
    limit = F.element_at(F.create_map(*[x for g, c in counts.items() for x in (F.lit(g), F.lit(fit_rows / c))]), F.col("grade"))
    picked = graded.where(share < limit).select(F.col("doc_id").cast("long").alias("labelled"), F.col("grade").cast("int").alias("grade"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).select("labelled", "grade", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, data, starts in bs.slices(batch.column("text")):
                doc, key = document_features(data, starts)
                edges = np.searchsorted(doc, np.arange(len(starts)))
                packed += [key[x:y].astype("<i4").tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("labelled"), batch.column("grade"), pa.array(packed, pa.binary())], names=["labelled", "grade", "features"])

    found = texts.mapInArrow(extract, "labelled long, grade int, features binary")
    return found.groupBy("labelled", "grade").agg(F.max("features").alias("features")).drop("labelled")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> SeverityModel:
    """A model of ``labels`` (doc_id, grade), fitted on a sample of about ``fit_rows`` rows of each grade."""
    rows = sorted((r["grade"], bytes(r["features"])) for r in fit_sample(docs, labels, fit_rows).collect())
    return fit([np.frombuffer(x, "<i4").astype(np.int64) for _, x in rows], np.array([g for g, _ in rows], dtype=np.int64))


def grade_of(toxic: Column, quality: Column) -> Column:
    """Severity grades of the two labels: 0 not toxic, 1 toxic, 2 toxic and of low quality too."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1))


def graded_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade_of(F.col("toxic"), F.col("quality")).alias("grade"))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), p_toxic, toxic."""
    model = spark.sparkContext.broadcast(train(docs, labels, fit_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.probabilities(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= reject)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, severity double, p_toxic double, toxic boolean")


def reject_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    model = spark.sparkContext.broadcast(train(docs, labels, fit_rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.probabilities(batch.column("text"))[:, 0] < reject))

    return docs.mapInArrow(keep, docs.schema)
