"""Stupid-backoff scores of documents against the n-gram counts of their own corpus.

The score of a word after its ``order - 1`` predecessors is the share f(context, word) / f(context) if that
n-gram occurs elsewhere, else ``BACKOFF`` times the score with a shorter context, down to f(word) / N. All counts
leave out the occurrence that is being scored, so a document can't vouch for itself with one occurrence; a word
that occurs nowhere else gets BACKOFF**(order - 1) / N. Contexts don't reach over documents.

Relationally: documents are dealt to chunks by hash; every chunk counts its distinct n-grams of each length and
sends them, with its counts, to the owners of their hash ranges; an owner's count table sums what it gets and
gives each chunk the corpus counts of the n-grams it named; each chunk then looks up the n-grams of its documents
and sums log scores by document. A chunk is about ``CHUNK_BYTES`` of text and an owner's table about
``OWNER_KEYS`` entries, whatever the corpus; both are groups of a shuffle. A frequent n-gram costs an owner one
entry for each chunk. Counts are exact up to collisions of 64-bit hashes.

What travels: text once, and 8 bytes for each distinct n-gram of a chunk and a few bytes for its counts.

A null text counts as empty; a text without words scores null with zero words. Repeated rows are documents of
their own and each vouch for the other. An empty table gives an empty result. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs

ORDER = 2
BACKOFF = 0.4
CHUNK_BYTES = 4 << 20
OWNER_KEYS = 1 << 20
_SENT = "owner int, chunk int, length int, n int, keys binary, counts binary"
_TOLD = "chunk int, owner int, length int, totals binary"


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each length, hashes of the n-grams and the places of their last words; then the words' texts."""
    a, b = bs.word_bounds(data, bs.SPACE_WORDS)
    words = bs.span_hashes(data, a, b)
    owner = bs.documents_of(starts, a)
    keys, places = [words], [np.arange(len(words))]
    for length in range(2, order + 1):
        at = np.flatnonzero(owner[: max(len(words) - length + 1, 0)] == owner[length - 1 :])
        keys.append(bs.window_hashes(words, length, length)[at])
        places.append(at + length - 1)
    return keys, places, owner


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    most = int(values.max()) if len(values) else 0
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _large(coded: bytes) -> np.ndarray:
    return np.frombuffer(coded, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}[coded[0]], offset=1).astype(np.int64)


def _slices(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    yield from bs.slices(table.column("text"))


def _tables(table: pa.Table, order: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one length in a chunk, ascending, and their counts."""
    lists = [grams(data, starts, order)[0][length - 1] for _, data, starts in _slices(table)]
    return np.unique(np.concatenate(lists), return_counts=True) if lists else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _send(chunk: int, table: pa.Table, order: int, owners: int) -> pa.Table:
    rows = []
    width = (1 << 64) // owners + 1
    for length in range(1, order + 1):
        keys, counts = _tables(table, order, length)
        # keys are in order, so an owner's are next to each other; owners without a key cost nothing
        own = (keys // np.uint64(width)).astype(np.int64) if owners > 1 else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False):
            rows.append((int(own[a]), chunk, length, b - a, keys[a:b].tobytes(), _small(counts[a:b])))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["owner", "chunk", "length", "n", "keys", "counts"])


def _own(table: pa.Table) -> pa.Table:
    """Corpus counts of the n-grams of each message, in the message's order."""
    lists = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_large(x) for x in table.column("counts").to_pylist()])
    everything = np.concatenate(lists)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    totals = np.empty(len(everything), dtype=np.int64)
    totals[order] = sums[np.cumsum(new) - 1]
    edges = np.cumsum([0] + [len(x) for x in lists])
    coded = [_small(totals[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table([table.column("chunk"), table.column("owner"), table.column("length"), pa.array(coded, pa.binary())], names=["chunk", "owner", "length", "totals"])


def _score(table: pa.Table, told: pa.Table, order: int, n_words: int, backoff: float) -> pa.Table:
    known = []
    said = sorted(zip(*(told.column(c).to_pylist() for c in ("length", "owner", "totals")), strict=True), key=lambda r: r[:2])
    for length in range(1, order + 1):
        keys, _ = _tables(table, order, length)
        parts = [_large(t) for n, _, t in said if n == length]
        known.append((keys, np.concatenate(parts) if parts else np.zeros(0, np.int64)))
    sizes, scores, unseen = [], [], []
    for _, data, starts in _slices(table):
        keys, places, owner = grams(data, starts, order)
        n = len(owner)
        # counts of the n-gram that ends at each word, without this occurrence
        counts = []
        for length in range(1, order + 1):
            own = np.zeros(n, dtype=np.int64)
            names, totals = known[length - 1]
            own[places[length - 1]] = totals[np.searchsorted(names, keys[length - 1])] - 1
            counts.append(own)
        others = max(n_words - 1, 1)
        value = np.where(counts[0] > 0, np.log(np.maximum(counts[0], 1) / others), np.log(1.0 / others))
        seen = counts[0] > 0
        for length in range(2, order + 1):
            has = np.zeros(n, dtype=bool)
            has[places[length - 1]] = True
            context = np.zeros(n, dtype=np.int64)
            context[1:] = counts[length - 2][:-1]
            hit = has & (counts[length - 1] > 0)
            share = np.log(np.maximum(counts[length - 1], 1) / np.maximum(context, 1))
            value = np.where(hit, share, np.where(has, value + np.log(backoff), value))
        first = bs.per_document(owner, len(starts) - 1)
        missing = np.concatenate(([0], np.cumsum(~seen)))
        sizes.append(np.diff(first))
        scores += [float(value[a:b].sum()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        unseen.append(missing[first[1:]] - missing[first[:-1]])
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    total = np.array(scores)
    empty = size == 0
    return pa.table(
        [
            table.column("doc_id"),
            pa.array(size, pa.int64()),
            pa.array(np.concatenate(unseen) if unseen else np.zeros(0, np.int64), pa.int64()),
            pa.array(total, pa.float64(), mask=empty),
            pa.array(total / np.maximum(size, 1), pa.float64(), mask=empty),
        ],
        names=["doc_id", "n_words", "n_unseen", "log_score", "mean_log_score"],
    )


def lm_scores(spark: SparkSession, docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per document: words, words that occur nowhere else, log score and its mean over words."""
    docs = docs.select("doc_id", "text")
    size, n_words = _sizes(docs)
    chunks = max(1, -(-size // CHUNK_BYTES))
    owners = max(1, -(-n_words * order // OWNER_KEYS))
    key: Column = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(chunks)).cast("int")
    dealt = docs.withColumn("chunk", key)

    sent = dealt.groupBy("chunk").applyInArrow(lambda k, table: _send(k[0].as_py(), table, order, owners), _SENT)
    told = sent.groupBy("owner").applyInArrow(_own, _TOLD)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, order, n_words, backoff)

    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, n_unseen long, log_score double, mean_log_score double")


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = words = 0
            for _, data, starts in bs.slices(batch.column("text")):
                size += len(data) - len(starts) + 1
                words += len(bs.word_bounds(data, bs.SPACE_WORDS)[0])
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([words], pa.int64())], names=["size", "words"])

    return tuple(x or 0 for x in docs.select("text").mapInArrow(count, "size long, words long").agg(F.sum("size"), F.sum("words")).first())
