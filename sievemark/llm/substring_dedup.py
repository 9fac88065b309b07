"""Substring dedup of word windows behind a count-min prefilter.

Texts are dealt once, by hash, to chunks of about ``chunks.CHUNK_BYTES``; all passes read that one shuffle.

Pass 1 sketches every chunk. A window of ``size`` words is sketched by its minimizer (the ``gram`` consecutive
words with the smallest hash): equal windows have equal minimizers, so the sketch's count of the minimizer is
at least the count of the window, at a quarter of the entries. The chunks' sketches are merged by addition, range
of cells by range of cells, and each chunk is told which of its own cells count two or more. Cells grow with the
corpus, and no task or driver holds them all.

Pass 2 reads the chunks again and sends on only windows estimated to occur twice or more. Occurrences of one
window within a chunk are settled there: all but those of the smallest document are covered, and travel as
ranges only. So a window that half of all documents hold sends a few rows a chunk. Open windows go to the owner of
their 96-bit hash's range, packed in columns; an owner's share is that of ``OWNER_BYTES`` of text. There each
document whose window also starts in a smaller document is covered, and its chunk is told. Pass 3 cuts the chunks.
No window is lost: every estimate is at least the true count.

Nulls and texts without words give rows with zero words and the hash of the empty string. Repeated rows each
get a row, but are worked on once; rows of one doc_id never cover each other, and are told apart by their texts
where these differ. A null doc_id covers nothing and keeps all words. An empty table gives an empty result. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from . import countmin as cm
from .chunks import CHUNK_BYTES, deal, repeat

WINDOW_WORDS = 13
GRAM_WORDS = 7
#: Text for each owner of a range of window hashes; an eighth of its windows travel as a rule, all at most.
OWNER_BYTES = 12 << 20
#: Sketch cells for each minimizer expected, and a key's cells.
CELLS, DEPTH = 8, 2
_FLUSH = 1 << 19
_FOUND = "docs binary, tags binary, starts binary, done binary, marks binary, low binary, high binary"
_SENT = f"owner int, chunk int, h1 binary, h2 binary, {_FOUND}"
_TOLD = f"chunk int, {_FOUND}"
_SENT_SCHEMA = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.binary()) for x in _SENT.split(", ")])
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _windows(data: np.ndarray, starts: np.ndarray, size: int, gram: int):
    """Word bounds, then for every window of one text: its first word, its text and its minimizer's hash."""
    a, b = bs.word_bounds(data, bs.SPACE_WORDS)
    words = bs.span_hashes(data, a, b)
    owner = bs.documents_of(starts, a)
    n = max(len(words) - size + 1, 0)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :][:n]) if n else np.zeros(0, np.int64)
    grams = bs.window_hashes(words, gram, 1)
    low = bs.sliding_argmin(grams, size - gram + 1)
    return a, b, words, owner, at, low, grams


def _minimizers(column: pa.ChunkedArray, size: int, gram: int) -> np.ndarray:
    """The minimizers of all windows, those of neighbouring windows once."""
    found = [np.zeros(0, np.uint64)]
    for _, data, starts in bs.slices(column):
        *_, at, low, grams = _windows(data, starts, size, gram)
        places = low[at]
        found.append(grams[places[np.flatnonzero(np.diff(places, prepend=-1))]])
    return np.concatenate(found)


def _pack(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return bs.planes(np.diff(doc, prepend=0)), bs.planes(np.diff(tag, prepend=0)), bs.planes(np.diff(start, prepend=np.int32(0)))


def _unpack(doc: bytes, tag: bytes, start: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(bs.unplanes(doc, "<i8")), np.cumsum(bs.unplanes(tag, "<i8")), np.cumsum(bs.unplanes(start, "<i4"), dtype=np.int32)


def _messages(chunk: int, found: list[tuple[np.ndarray, ...]], owners: int) -> pa.RecordBatch:
    """Candidate windows of some slices: open ones for the owners of their hashes, settled ones as ranges."""
    h1, h2, doc, tag, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, tag, doc, h2, h1))
    h1, h2, doc, tag, start = h1[order], h2[order], doc[order], tag[order], start[order]
    # runs of one window; only occurrences in the run's smallest document are open
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    settled = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    rest = np.flatnonzero(settled)
    rest = rest[np.lexsort((start[rest], tag[rest], doc[rest]))]
    d, t, s = doc[rest], tag[rest], start[rest]
    cut = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(t) != 0) | (np.diff(s) > 1))) if len(rest) else rest
    end = np.append(cut[1:], len(rest)) - 1 if len(rest) else rest
    open_ = np.flatnonzero(~settled)
    owner = (h1[open_] >> np.uint64(32)).astype(np.int64) * owners >> 32
    by = np.lexsort((start[open_], tag[open_], doc[open_], owner))
    open_, owner = open_[by], owner[by]
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    rows = []
    for k, (a, b) in enumerate(zip(edges.tolist(), [*edges[1:].tolist(), len(owner)], strict=True)):
        mine = open_[a:b]
        told = (d[cut], t[cut], s[cut], s[end]) if k == 0 else (d[:0], t[:0], s[:0], s[:0])
        rows.append((int(owner[a]), chunk, h1[mine].tobytes(), h2[mine].tobytes(), *_pack(doc[mine], tag[mine], start[mine]), *(x.tobytes() for x in told)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT_SCHEMA, strict=True)], schema=_SENT_SCHEMA)


def _candidates(chunk: int, table: pa.Table, told: pa.Table, cells: int, size: int, gram: int, owners: int) -> pa.Table:
    """Windows of a chunk whose minimizers all owners of cells put at two or more."""
    ids, tags = (np.asarray(table.column(x).to_numpy(), dtype=np.int64) for x in ("doc_id", "tag"))
    held, keys = [], [np.zeros(0, np.uint64)]
    for row, data, starts in bs.slices(table.column("text")):
        _, _, words, owner, at, low, grams = _windows(data, starts, size, gram)
        places = low[at]
        new = np.diff(places, prepend=-1) != 0
        keys.append(grams[places[new]])
        held.append((row, words, owner, at, np.cumsum(new) - 1, bs.per_document(owner, len(starts) - 1)))
    many = cm.classes(np.concatenate(keys), told, cells, DEPTH) > 0
    sent, found, size_held, done = [], [], 0, 0
    for (row, words, owner, at, run, first), mine in zip(held, keys[1:], strict=True):
        at = at[many[done + run]]
        done += len(mine)
        if not len(at):
            continue
        h1 = bs.window_hashes_at(words, at, size, 2)
        h2 = (bs.window_hashes_at(words, at, size, 3) >> np.uint64(32)).astype(np.uint32)
        found.append((h1, h2, ids[row + owner[at]], tags[row + owner[at]], (at - first[owner[at]]).astype(np.int32)))
        size_held += len(at)
        if size_held >= _FLUSH:
            sent.append(_messages(chunk, found, owners))
            found, size_held = [], 0
    if found:
        sent.append(_messages(chunk, found, owners))
    return pa.Table.from_batches(sent, schema=_SENT_SCHEMA)


def _meet(table: pa.Table) -> pa.Table:
    """The windows of one owner: each message's windows that also start in a smaller document, for its chunk."""
    h1 = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("h1").to_pylist()])
    h2 = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("h2").to_pylist()])
    parts = [_unpack(*x) for x in zip(*(table.column(c).to_pylist() for c in ("docs", "tags", "starts")), strict=True)]
    doc = np.concatenate([x[0] for x in parts])
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[order], h2[order], doc[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    late = np.zeros(len(doc), dtype=bool)
    late[order] = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    edges = np.cumsum([0] + [len(x[0]) for x in parts]).tolist()
    packed = [_pack(*(x[late[a:b]] for x in part)) for part, a, b in zip(parts, edges[:-1], edges[1:], strict=True)]
    columns = [table.column("chunk"), *(pa.array(c, pa.binary()) for c in zip(*packed, strict=True)), *(table.column(c) for c in ("done", "marks", "low", "high"))]
    return pa.table(columns, names=[x.split()[0] for x in _TOLD.split(", ")])


def _ranges(told: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """First and last starts of covered windows by (doc_id, tag)."""
    late = [_unpack(*x) for x in zip(*(told.column(c).to_pylist() for c in ("docs", "tags", "starts")), strict=True)]
    done = [tuple(np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.int32, np.int32), strict=True)) for row in zip(*(told.column(c).to_pylist() for c in ("done", "marks", "low", "high")), strict=True)]
    ranges = [(d, t, s, s) for d, t, s in late] + done
    if not ranges:
        return {}
    doc, tag, low, high = (np.concatenate(x) for x in zip(*ranges, strict=True))
    order = np.lexsort((tag, doc))
    doc, tag, low, high = doc[order], tag[order], low[order].astype(np.int64), high[order].astype(np.int64)
    edges = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(tag) != 0))).tolist() if len(doc) else []
    return {(int(doc[a]), int(tag[a])): (low[a:b], high[a:b]) for a, b in zip(edges, [*edges, len(doc)][1:], strict=True)}


def _kept(table: pa.Table | pa.RecordBatch, ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], size: int) -> list[pa.Array]:
    """Words, words removed and the hash of those kept for every text."""
    n_words, n_removed, digests = [], [], []
    names = list(zip(table.column("doc_id").to_pylist(), table.column("tag").to_pylist(), strict=True))
    for row, data, starts in bs.slices(table.column("text")):
        a, b = bs.word_bounds(data, bs.SPACE_WORDS)
        first = bs.per_document(bs.documents_of(starts, a), len(starts) - 1).tolist()
        raw = data.tobytes()
        for i, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
            at = np.arange(lo, hi)
            if names[row + i] in ranges:
                low, high = ranges[names[row + i]]
                at = at[~bs.covered(hi - lo, low, high - low + size)]
            n_words.append(hi - lo)
            n_removed.append(hi - lo - len(at))
            digests.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(a[at].tolist(), b[at].tolist(), strict=True)])).hexdigest())
    return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]


def substring_dedup(spark: SparkSession, docs: DataFrame, size: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """One row per document: words, words removed, and the SHA-256 of the words kept, joined by one space."""
    total = cm.text_bytes(docs)
    cells = cm.growing_cells(total // 24, CELLS)
    owners = max(1, -(-total // OWNER_BYTES))
    chunks = deal(docs, total, CHUNK_BYTES).groupBy("chunk")

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return cm.questions(key[0].as_py(), _minimizers(table.column("text"), size, gram), cells, DEPTH)

    def candidates(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        return _candidates(key[0].as_py(), table, told, cells, size, gram, owners)

    def kept(table: pa.Table, told: pa.Table) -> pa.Table:
        return pa.table([table.column("doc_id"), *_kept(table, _ranges(told), size), table.column("copies")], names=["doc_id", "n_words", "n_removed", "kept_sha256", "copies"])

    told = chunks.applyInArrow(sketch, cm.ASKED_SCHEMA).groupBy("owner").applyInArrow(lambda table: cm.answers(table), cm.TOLD_SCHEMA)
    sent = chunks.cogroup(told.groupBy("chunk")).applyInArrow(candidates, _SENT)
    found = sent.groupBy("owner").applyInArrow(_meet, _TOLD)
    rows = chunks.cogroup(found.groupBy("chunk")).applyInArrow(kept, f"{_KEPT}, copies long")
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_kept(batch, {}, size)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    nameless = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("tag")).mapInArrow(whole, _KEPT)
    return repeat(rows).unionByName(nameless)
