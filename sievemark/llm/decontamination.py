"""Benchmark decontamination by word-level Wu-Manber search.

The windows of ``size`` consecutive words of every benchmark item (the whole item if it is shorter) are the
patterns, by length. A block is two consecutive words (one word for patterns of one word). The shift table holds
for every block of a pattern how far the search may move on when it meets the block at the end of its window;
any other block allows the longest move, so the search looks at about one block in ``size - 1``. Where the shift
is zero, the hash of the window's last block (its suffix) and of its first block (its prefix) pick a bucket of
patterns, and their words are compared with the window's. The search runs in lanes, many places of a slice of
documents at once.

The benchmark is read in parts of at most ``PART_BYTES`` of text; each part is one broadcast and one search, so
what is broadcast has a bound and a larger benchmark takes more searches. Tables are packed arrays over the words of the
part, about ten times its text. Documents are neither shuffled nor
joined: each task reports its own documents' hits; with several parts the hits of a document are merged by doc_id.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters. A null or empty text has none.
Repeated rows each get a row (with several parts, rows of one doc_id are told apart by their text). Items of one
item_id count once. A null item_id counts as the empty string. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs

WINDOW_WORDS = 13
PART_BYTES = 8 << 20
_LANE = 192
_HITS = "doc_id long, tag long, n_words long, words array<int>, item_ids array<string>"


class Stream:
    """The words of all items of a part, one after another."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        parts, offset = [], 0
        for row, data, starts in bs.slices(pa.array([t for _, t in items], pa.large_string())):
            data = bs.LOWER[data]
            a, b = bs.word_bounds(data, bs.LETTER_WORDS)
            parts.append((data, (a + offset).astype(np.int32), (b + offset).astype(np.int32), bs.span_hashes(data, a, b), (row + bs.documents_of(starts, a)).astype(np.int32)))
            offset += len(data)
        data, self.starts, self.ends, self.hashes, self.owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.raw = data.tobytes()
        self.names = [name for name, _ in items]

    def text(self, first: int, words: int) -> bytes:
        return b" ".join([self.raw[s:e] for s, e in zip(self.starts[first : first + words].tolist(), self.ends[first : first + words].tolist(), strict=True)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("hashes", "owner")}  # used to build tables only


def bucket_of(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The bucket of windows with these last and first blocks."""
    return bs.mix(suffix ^ bs.mix(prefix))


class Patterns:
    """Tables of the patterns of one length: places ``at`` of a stream of words, ascending."""

    def __init__(self, words: int, stream: Stream, at: np.ndarray) -> None:
        self.words, self.stream = words, stream
        self.block = min(2, words)
        self.longest = words - self.block + 1
        # the shift of a block: from its last place in any pattern, the pattern that starts first
        blocks = bs.window_hashes(stream.hashes, self.block, 7)
        every = np.arange(len(blocks))
        begin = at[np.minimum(np.searchsorted(at, every - self.longest + 1), len(at) - 1)]
        inside = np.flatnonzero((begin <= every) & (every - begin < self.longest))
        self.keys, of = np.unique(blocks[inside], return_inverse=True)
        self.shifts = np.full(len(self.keys), self.longest, dtype=np.int16)
        np.minimum.at(self.shifts, of, (self.longest - 1 - (inside - begin[inside])).astype(np.int16))
        # equal patterns share an entry of their bucket
        bucket = bucket_of(blocks[at + words - self.block], blocks[at])
        one, two = (bs.window_hashes_at(stream.hashes, at, words, salt) for salt in (8, 9))
        order = np.lexsort((stream.owner[at], two, one, bucket))
        bucket, one, two, at, item = bucket[order], one[order], two[order], at[order], stream.owner[at][order]
        same = (bucket[1:] == bucket[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        entry = np.flatnonzero(np.append(True, ~same))
        self.buckets, self.firsts = bucket[entry], at[entry].astype(np.int32)
        kept = np.flatnonzero(np.append(True, ~same | (item[1:] != item[:-1])))
        self.items = item[kept]
        self.bounds = np.append(np.searchsorted(kept, entry), len(kept)).astype(np.int32)

    def shift(self, blocks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        return np.where(self.keys[at] == blocks, self.shifts[at], self.longest)

    def names(self, entry: int) -> list[str]:
        return [self.stream.names[k] for k in self.items[self.bounds[entry] : self.bounds[entry + 1]].tolist()]


def patterns_of(items: list[tuple[str, str | None]], size: int) -> list[Patterns]:
    """Pattern tables of (item_id, text) rows, one for each length of pattern."""
    if not items:
        return []
    stream = Stream(items)
    counts = np.bincount(stream.owner, minlength=len(items))
    first = np.cumsum(counts) - counts
    out = []
    for length in sorted({min(size, n) for n in counts.tolist() if n}):
        n = len(stream.owner) - size + 1
        at = np.flatnonzero(stream.owner[:n] == stream.owner[size - 1 :]) if length == size else first[counts == length]
        out.append(Patterns(length, stream, at))
    return out


def _search(patterns: Patterns, words: np.ndarray, owner: np.ndarray, raw: bytes, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(first word, pattern) of every occurrence in a slice."""
    m, block = patterns.words, patterns.block
    n = len(words) - m + 1
    if n <= 0:
        return []
    blocks = bs.window_hashes(words, block, 7)
    # each lane owns _LANE windows, told by their first words
    at = np.arange(0, n, _LANE)
    end = np.minimum(at + _LANE, n)
    suspects = []
    while len(at):
        move = patterns.shift(blocks[at + m - block])
        zero = move == 0
        suspects.append(at[zero])
        at = at + np.maximum(move, 1)
        alive = at < end
        at, end = at[alive], end[alive]
    places = np.concatenate(suspects)
    places = places[owner[places] == owner[places + m - 1]]
    if not len(places):
        return []
    bucket = bucket_of(blocks[places + m - block], blocks[places])
    low, high = (np.searchsorted(patterns.buckets, bucket, side) for side in ("left", "right"))
    found = []
    for p, x, y in zip(*(v[high > low].tolist() for v in (places, low, high)), strict=True):
        window = b" ".join([raw[s:e] for s, e in zip(a[p : p + m].tolist(), b[p : p + m].tolist(), strict=True)])
        found += [(p, k) for k in range(x, y) if patterns.stream.text(patterns.firsts[k], m) == window]
    return found


def _hits(batches: Iterator[pa.RecordBatch], tables: list[Patterns]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, hit_words, item_lists = [], [], []
        for _, data, starts in bs.slices(batch.column("text")):
            data = bs.LOWER[data]
            a, b = bs.word_bounds(data, bs.LETTER_WORDS)
            words = bs.span_hashes(data, a, b)
            owner = bs.documents_of(starts, a)
            raw = data.tobytes()
            first = bs.per_document(owner, len(starts) - 1)
            n_words += np.diff(first).tolist()
            words_of: dict[int, set[int]] = {}
            items_of: dict[int, set[str]] = {}
            for patterns in tables:
                for p, k in _search(patterns, words, owner, raw, a, b):
                    d = int(owner[p])
                    words_of.setdefault(d, set()).update(range(p - int(first[d]), p - int(first[d]) + patterns.words))
                    items_of.setdefault(d, set()).update(patterns.names(k))
            hit_words += [sorted(words_of.get(d, ())) for d in range(len(starts) - 1)]
            item_lists += [sorted(items_of.get(d, ())) for d in range(len(starts) - 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(n_words, pa.int64()), pa.array(hit_words, pa.list_(pa.int32())), pa.array(item_lists, pa.list_(pa.string()))],
            names=["doc_id", "tag", "n_words", "words", "item_ids"],
        )


def _parts(benchmark: DataFrame, limit: int) -> list[list[int]]:
    """Numbers of the slots of each part: items are dealt to slots by hash, and parts hold slots up to ``limit`` bytes."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, -(-total * 4 // limit)) if total > limit else 1
    sizes = benchmark.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(slots)).alias("slot")).agg(F.sum(F.octet_length("text")).alias("size")).collect()
    parts: list[list[int]] = []
    held = 0
    for row in sorted(sizes, key=lambda r: r["slot"]):
        size = row["size"] or 0
        if not parts or (held and held + size > limit):
            parts.append([])
            held = 0
        parts[-1].append(row["slot"])
        held += size
    return [[slots, *p] for p in parts]


def benchmark_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: words, places of hit words, and items with occurring windows."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found: DataFrame | None = None
    parts = _parts(items, part_bytes) or [[1]]
    for slots, *own in parts:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slots)).isin(own)).collect() if own else []
        tables = spark.sparkContext.broadcast(patterns_of([(r["item_id"], r["text"]) for r in rows], size))
        part = docs.mapInArrow(lambda batches, tables=tables: _hits(batches, tables.value), _HITS)
        found = part if found is None else found.union(part)
    if len(parts) > 1:
        merged = found.groupBy("doc_id", "tag", "n_words")
        found = merged.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.count(F.lit(1)).alias("copies"))
        found = found.withColumn("copies", F.explode(F.sequence(F.lit(1), (F.col("copies") / len(parts)).cast("int")))).drop("copies")
    return found


def _contaminated() -> Column:
    n_hit = F.size("words").cast("long")
    return (n_hit > 0) & (n_hit * 20 >= F.col("n_words"))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return benchmark_hits(spark, docs, benchmark, size, part_bytes).select(
        "doc_id",
        "n_words",
        F.size("words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns; rows are told by doc_id and text."""
    bad = benchmark_hits(spark, docs, benchmark).where(_contaminated()).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_tag"))
    return docs.join(bad, same, "left_anti")
