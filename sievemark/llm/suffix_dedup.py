"""Removal of byte strings of ``size`` bytes that occur more than once in a corpus.

Every window of ``size`` bytes is anchored at its minimizer: among its ``gram``-byte strings with a small hash
(or all of them, if none is small) the leftmost one with the smallest hash. Equal windows have the same anchor
at the same place in them, so windows meet by anchor, and the windows of one anchor occurrence travel as one
run of bytes, about three times the text for repeated anchors and nothing for others: a merged count-min sketch
of the anchors tells which can be repeated. Texts are dealt once, by hash, to chunks; chunks ask the owners of ranges of
the sketch's cells, which grow with the corpus, so that no task or driver holds them all.

Runs of one anchor meet in one partition. Each partition cuts them into ``BLOCK``-byte symbols on a grid that
the anchor fixes, builds the suffix array of the symbol sequences by linear Lyndon grouping
(``lyndon_suffix_array``), and takes from neighbours in it the intervals of suffixes that share as many symbols
as a window holds. Windows of an interval differ at most in the few bytes before and after those symbols, which
are compared themselves.

Anchors that the sketch puts at ``HOT`` occurrences or more would fill one partition. Their runs are cut into
``PIECES`` overlapping pieces by how many bytes of a window lie before the anchor; all windows of a piece share a
core of more than 350 bytes, and pieces meet by anchor, piece and core, so that equal windows still meet. A second
sketch, asked in the same way, drops pieces whose core occurs once. Of equal pieces one travels to its group, with the
number of occurrences; groups go through the same suffix arrays, and the ranges found are joined to the occurrences. A window
takes the same way wherever it occurs, and no table has a row for each window. Ranges go back to the chunks, which cut their texts.

A null or empty text gives zeros and the hash of no bytes. Repeated rows are documents of their own: their texts
occur elsewhere. They are counted and worked on once. Rows are told apart by doc_id and text, so a doc_id may repeat
with other texts or be null. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from . import countmin as cm
from .chunks import deal, repeat
from .lyndon_suffix_array import suffix_array

SIZE = 400
GRAM = 64
BLOCK = 16
HOT = 4096
PIECES = 8
_RARE = 31
_BUNDLE = 1 << 20
#: Text of a chunk: its pieces, eight for each hot anchor, are held at once.
CHUNK_BYTES = 4 << 20
#: Sketch cells for each anchor expected, and a key's cells.
CELLS, DEPTH = 8, 2
_RUNS = "anchor long, lead int, body binary, chunk int, doc_ids array<long>, tags array<long>, starts array<int>, hot boolean"
#: A slice of a chunk: first row, bytes, starts, and its anchors' hashes, places, first and last windows and texts.
_Anchored = tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]
_FOUND = "chunk int, doc_ids array<long>, tags array<long>, starts array<int>, ranges array<struct<start: int, stop: int>>"
_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _previous(values: np.ndarray, places: np.ndarray, reach: int, strict: bool) -> np.ndarray:
    """Place of the nearest earlier entry with a smaller (or, if not strict, equal) value within ``reach``; else -1."""
    n = len(values)
    out = np.full(n, -1, dtype=np.int64)
    active = np.arange(1, n)
    back = 1
    while len(active):
        j = active - back
        near = places[active] - places[j] <= reach
        active, j = active[near], j[near]
        hit = values[j] < values[active] if strict else values[j] <= values[active]
        out[active[hit]] = places[j[hit]]
        active = active[~hit]
        back += 1
        active = active[active >= back]
    return out


def anchor_runs(data: np.ndarray, starts: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every anchor: its hash, its place, its first and its last window, and its text's index."""
    empty = (np.zeros(0, np.uint64),) + tuple(np.zeros(0, np.int64) for _ in range(4))
    n = len(data) - gram + 1
    if n <= 0:
        return empty
    at = np.arange(n)
    hashes = bs.span_hashes(data, at, at + gram)
    span = size - gram
    last = starts[1:] - 1 - size  # last window of each text
    rare = np.flatnonzero((hashes & np.uint64(_RARE)) == 0)
    owner = bs.documents_of(starts, rare)
    fits = (rare + gram <= starts[owner + 1] - 1) & (starts[owner + 1] - 1 - starts[owner] >= size)
    rare, owner = rare[fits], owner[fits]
    values = hashes[rare]
    before = _previous(values, rare, span, strict=False)
    after = _previous(values[::-1], -rare[::-1], span, strict=True)[::-1]
    lo = np.maximum(np.maximum(rare - span, before + 1), starts[owner])
    hi = np.minimum(rare, last[owner])
    nxt = np.where(after == -1, len(data) + size, -after) - span - 1
    hi = np.minimum(hi, nxt)
    good = lo <= hi
    rare, lo, hi, owner = rare[good], lo[good], hi[good], owner[good]
    # windows without a rare gram
    have = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(have, lo, 1)
    np.add.at(have, hi + 1, -1)
    valid = np.zeros(len(data) + 1, dtype=np.int32)
    long = last >= starts[:-1]
    np.add.at(valid, starts[:-1][long], 1)
    np.add.at(valid, last[long] + 1, -1)
    bare = np.flatnonzero((np.cumsum(valid) > 0) & (np.cumsum(have) == 0))
    places = [rare]
    firsts, lasts, owners = [lo], [hi], [owner]
    if len(bare):
        for piece in np.split(bare, np.flatnonzero(np.diff(bare) > 1) + 1):
            a, b = int(piece[0]), int(piece[-1])
            low = a + bs.sliding_argmin(hashes[a : b + span + 1], span + 1)
            new = np.flatnonzero(np.diff(low, prepend=-1))
            places.append(low[new])
            firsts.append(a + new)
            lasts.append(a + np.append(new[1:], len(low)) - 1)
            owners.append(bs.documents_of(starts, low[new]))
    place = np.concatenate(places)
    return hashes[place], place, np.concatenate(firsts), np.concatenate(lasts), np.concatenate(owners)


def _anchored(table: pa.Table, size: int, gram: int) -> list[_Anchored]:
    return [(row, data, starts, anchor_runs(data, starts, size, gram)) for row, data, starts in bs.slices(table.column("text"))]


def _all(keys: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *keys])


def _picked(found: list[_Anchored], classes: np.ndarray) -> list[_Anchored]:
    """The anchors that ``classes`` marks, over all slices of a chunk."""
    edges = np.cumsum([0] + [len(x[3][0]) for x in found]).tolist()
    return [(row, data, starts, tuple(x[classes[a:b]] for x in runs)) for (row, data, starts, runs), a, b in zip(found, edges[:-1], edges[1:], strict=True)]


def _rows(chunk: int, table: pa.Table, found: list[_Anchored], size: int, hot: bool) -> pa.Table:
    """Rows of a chunk's runs; equal runs of a slice share one row."""
    ids, tags = (np.asarray(table.column(x).fill_null(-1).to_numpy(), dtype=np.int64) for x in ("doc_id", "tag"))
    out = []
    for row, data, starts, (group, place, first, last, owner) in found:
        raw = data.tobytes()
        seen: dict[tuple[int, int, bytes], list[int]] = {}
        for k, (h, p, a, b) in enumerate(zip(group.view(np.int64).tolist(), place.tolist(), first.tolist(), (last + size).tolist(), strict=True)):
            seen.setdefault((h, p - a, raw[a:b]), []).append(k)
        members = list(seen.values())
        flat = np.fromiter((k for m in members for k in m), np.int64)
        offsets = pa.array(np.cumsum([0] + [len(m) for m in members]).astype(np.int32))
        lists = (ids[row + owner[flat]], tags[row + owner[flat]], (first - starts[owner])[flat].astype(np.int32))
        plain = zip(zip(*seen, strict=True) if seen else ((), (), ()), (pa.int64(), pa.int32(), pa.binary()), strict=True)
        columns = [pa.array(x, t) for x, t in plain] + [pa.array([chunk] * len(seen), pa.int32())]
        out.append(pa.table(columns + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists] + [pa.array([hot] * len(seen), pa.bool_())], names=_RUN_TYPES.names))
    return pa.concat_tables([_RUN_TYPES.empty_table(), *out])


_RUN_TYPES = pa.schema(
    [("anchor", pa.int64()), ("lead", pa.int32()), ("body", pa.binary()), ("chunk", pa.int32())]
    + [("doc_ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("hot", pa.bool_())]
)


def hot_pieces(data: np.ndarray, runs: tuple[np.ndarray, ...], size: int, gram: int, pieces: int = PIECES) -> tuple[np.ndarray, ...]:
    """Pieces of hot runs: group, place of the anchor, first and last window, text.

    A piece holds the windows with ``low`` to ``high`` bytes before the anchor; its core is what they have in common.
    """
    hashes, place, lo, hi, owner = runs
    bounds = np.linspace(0, size - gram + 1, min(pieces, size - gram + 1) + 1).astype(np.int64)
    out = []
    for k in range(len(bounds) - 1):
        low, high = bounds[k], bounds[k + 1] - 1
        first, last = np.maximum(lo, place - high), np.minimum(hi, place - low)
        at = np.flatnonzero(first <= last)
        core = bs.span_hashes(data, place[at] - low, place[at] - high + size)
        out.append((bs.mix(hashes[at] ^ bs.mix(core + np.uint64(k))), place[at], first[at], last[at], owner[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _intervals(text: np.ndarray, whole: int) -> np.ndarray:
    """For every place of ``text`` the number of the interval of suffixes that share its first ``whole`` symbols.

    Neighbours in the suffix array are compared symbol by symbol; -1 where no neighbour shares as many.
    """
    order = np.array(suffix_array(text.tolist()), dtype=np.int64)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(np.maximum(a, b) + whole <= len(text))
    for k in range(whole):
        if not len(alike):
            break
        alike = alike[text[a[alike] + k] == text[b[alike] + k]]
    joined = np.zeros(len(order) + 1, dtype=bool)
    joined[alike + 1] = True
    number = np.cumsum(~joined[:-1])
    out = np.full(len(text), -1, dtype=np.int64)
    held = joined[:-1] | joined[1:]
    out[order[held]] = number[held]
    return out


#: Masks of the first and of the last n bytes of sixteen, as two little-endian numbers.
_FIRST = [np.array([(((1 << 8 * n) - 1) >> shift) & (1 << 64) - 1 for n in range(17)], dtype=np.uint64) for shift in (0, 64)]
_LAST = [np.array([((((1 << 8 * n) - 1) << 8 * (16 - n)) >> shift) & (1 << 64) - 1 for n in range(17)], dtype=np.uint64) for shift in (0, 64)]


def _beside(data: np.ndarray, at: np.ndarray, n: np.ndarray, before: bool) -> list[np.ndarray]:
    """The ``n`` (16 at most) bytes before or from ``at``, as two numbers, zero where there are fewer."""
    padded = np.concatenate((np.zeros(16, np.uint8), data, np.zeros(16, np.uint8)))
    numbers = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    first = at if before else at + 16
    return [numbers[first + 8 * k] & (_LAST if before else _FIRST)[k][n] for k in range(2)]


def repeated_windows(bundle: list[tuple[int, int, bytes, int]], size: int, block: int = BLOCK) -> list[list[tuple[int, int]]]:
    """Ranges of repeated windows of every run of a bundle of whole anchor groups.

    A run is (anchor, bytes before the anchor, body, occurrences); runs of one anchor have different bodies.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in bundle]
    groups: dict[int, list[int]] = {}
    for r, (anchor, _, body, count) in enumerate(bundle):
        groups.setdefault(anchor, []).append(r)
        if count > 1:
            out[r].append((0, len(body) - size))
    mixed = [r for g in groups.values() if len(g) > 1 and any(bundle[r][3] == 1 for r in g) for r in g]
    if not mixed:
        return out
    bodies = [bundle[r][2] for r in mixed]
    sizes = np.array([len(x) for x in bodies], dtype=np.int64)
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    origin = np.concatenate(([0], np.cumsum(sizes)))
    grid = np.array([bundle[r][1] % block for r in mixed], dtype=np.int64)
    counts = (sizes - grid) // block
    # block starts, run by run, with one separator after every run
    run_of = np.repeat(np.arange(len(mixed)), counts)
    within = np.arange(len(run_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = origin[run_of] + grid[run_of] + within * block
    symbols = data[begins[:, None] + np.arange(block)] if len(begins) else np.zeros((0, block), np.uint8)
    _, ranks = np.unique(np.ascontiguousarray(symbols).view(f"V{block}").ravel(), return_inverse=True)
    text = np.empty(len(ranks) + len(mixed), dtype=np.int64)
    slot = np.arange(len(ranks)) + run_of
    text[slot] = ranks + len(mixed)
    ends = np.cumsum(counts + 1) - 1
    text[ends] = np.arange(len(mixed))
    whole = (size - block + 1) // block  # whole blocks in any window
    interval = _intervals(text, whole)
    chosen = np.flatnonzero(interval[slot] >= 0)  # blocks at which a repeated sequence starts
    if not len(chosen):
        return out
    # windows whose first whole block is such a block
    first = np.where(within[chosen] == 0, 0, begins[chosen] - origin[run_of[chosen]] - block + 1)
    stop = begins[chosen] - origin[run_of[chosen]]
    stop = np.minimum(stop, sizes[run_of[chosen]] - size)
    ok = stop >= first
    chosen, first, stop = chosen[ok], first[ok], stop[ok]
    n = stop - first + 1
    begin_block = np.repeat(begins[chosen], n)
    owner, of = np.repeat(run_of[chosen], n), np.repeat(interval[slot[chosen]], n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    begin = origin[owner] + start
    before = begin_block - begin
    lead = np.array([bundle[r][1] for r in mixed], dtype=np.int64)
    number = {a: k for k, a in enumerate(groups)}
    anchor = np.array([number[bundle[r][0]] for r in mixed], dtype=np.int64)
    after = begin_block + whole * block
    keys = [anchor[owner], lead[owner] - start, of, *_beside(data, begin_block, before, True), *_beside(data, after, begin + size - after, False)]
    by = np.lexsort(keys)
    new = np.zeros(max(len(by) - 1, 0), dtype=bool)
    for key in keys:
        new |= key[by][1:] != key[by][:-1]
    equal = np.zeros(len(by) + 1, dtype=bool)
    equal[1:-1] = ~new
    twice = np.zeros(len(by), dtype=bool)
    twice[by] = equal[1:] | equal[:-1]
    single = np.array([bundle[r][3] == 1 for r in mixed])
    hit = np.flatnonzero(twice & single[owner])
    owner, start = owner[hit], start[hit]
    if len(hit):
        by = np.lexsort((start, owner))
        owner, start = owner[by], start[by]
        new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(start) > 1)))
        for i, j in zip(new.tolist(), np.append(new[1:], len(owner)).tolist(), strict=True):
            out[mixed[owner[i]]].append((int(start[i]), int(start[j - 1])))
    return out


def _bundles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[dict[tuple[int, int, bytes], list], list[list[tuple[int, int]]]]]:
    """Rows sorted by anchor, in bundles of whole groups: the rows of every run, and its ranges of repeated windows.

    A row's last column says how often the run occurs in it.
    """
    pending: dict[tuple[int, int, bytes], list] = {}
    held = 0
    last = None

    def settle() -> tuple[dict[tuple[int, int, bytes], list], list[list[tuple[int, int]]]]:
        return pending, repeated_windows([(*key, sum(x[-1] for x in rows)) for key, rows in pending.items()], size)

    for batch in batches:
        for anchor, lead, body, *rest in zip(*batch.to_pydict().values(), strict=True):
            if anchor != last and held >= _BUNDLE:
                yield settle()
                pending, held = {}, 0
            last = anchor
            key = (anchor, lead, body)
            if key not in pending:
                pending[key] = []
                held += len(body)
            pending[key].append(rest)
    if pending:
        yield settle()


def _hot_pieces(table: pa.Table, size: int, gram: int) -> list[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """Bytes and row bounds of hot runs, by slices, and their pieces, whose texts are the runs' rows."""
    bodies = table.column("body").to_pylist()
    anchors, leads = table.column("anchor").to_numpy().view(np.uint64), table.column("lead").to_numpy().astype(np.int64)
    sizes = np.array([len(x) for x in bodies], dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // bs.SLICE_BYTES
    out = []
    for rows in np.split(np.arange(len(bodies)), np.flatnonzero(np.diff(part)) + 1):
        data = np.frombuffer(b"".join([bodies[r] for r in rows.tolist()]), dtype=np.uint8)
        begin = np.cumsum(sizes[rows]) - sizes[rows]
        origin = np.zeros(len(bodies), np.int64)
        origin[rows] = begin
        out.append((data, origin, hot_pieces(data, (anchors[rows], begin + leads[rows], begin, begin + sizes[rows] - size, rows), size, gram)))
    return out


def _piece_rows(table: pa.Table, told: pa.Table, cells: int, size: int, gram: int) -> pa.Table:
    """Rows of the pieces of a chunk's hot runs whose core may be repeated; equal pieces share one row."""
    found = _hot_pieces(table, size, gram)
    many = cm.classes(_all([x[2][0] for x in found]), told, cells, DEPTH) >= 1
    docs, tags, starts = (table.column(x).to_pylist() for x in ("doc_ids", "tags", "starts"))
    seen: dict[tuple[int, int, bytes], tuple[list[int], list[int], list[int]]] = {}
    done = 0
    for data, origin, (group, *rest) in found:
        pick = many[done : done + len(group)]
        done += len(group)
        raw = data.tobytes()
        for h, p, a, b, r in zip(*(x[pick].tolist() for x in (group.view(np.int64), *rest)), strict=True):
            own = seen.setdefault((h, p - a, raw[a : b + size]), ([], [], []))
            own[0].extend(docs[r])
            own[1].extend(tags[r])
            shift = a - int(origin[r])
            own[2].extend([x + shift for x in starts[r]])
    chunk = table.column("chunk")[0].as_py() if len(table) else 0
    rows = [(*key, chunk, *own, True) for key, own in seen.items()]
    columns = zip(*rows, strict=True) if rows else ([] for _ in _RUN_TYPES)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RUN_TYPES, strict=True)], schema=_RUN_TYPES)


_RANGE = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_FOUND_TYPES = pa.schema([*(_RUN_TYPES.field(x) for x in ("chunk", "doc_ids", "tags", "starts")), ("ranges", pa.list_(_RANGE))])
_PIECE_TYPES = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("ranges", pa.list_(_RANGE))])


def _judge(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of runs with a repeated window, without anchor, bytes and number of occurrences, and with its ranges."""
    for runs, ranges in _bundles(batches, size):
        found = [(*row[:-1], [{"start": x, "stop": y} for x, y in own]) for rows, own in zip(runs.values(), ranges, strict=True) if own for row in rows]
        columns = zip(*found, strict=True) if found else ([] for _ in schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repeated_ranges(dealt: DataFrame, total: int, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Ranges (start, stop) of window starts, in bytes from starts, of windows that occur twice or more in ``dealt`` texts.

    ``dealt`` has chunk, doc_id, text and tag, which tells texts of one doc_id apart; ``total`` is the bytes of all texts.
    """
    cells = cm.growing_cells(total // (size - gram) * 2, CELLS)
    chunks = dealt.groupBy("chunk")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return cm.questions(key[0].as_py(), _all([x[3][0] for x in _anchored(table, size, gram)]), cells, DEPTH)

    def told_of(asked: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
        return asked.groupBy("owner").applyInArrow(lambda table: cm.answers(table, bounds), cm.TOLD_SCHEMA)

    def runs(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        found = _anchored(table, size, gram)
        classes = cm.classes(_all([x[3][0] for x in found]), told, cells, DEPTH)
        return pa.concat_tables([_rows(key[0].as_py(), table, _picked(found, pick), size, hot) for hot, pick in ((False, classes == 1), (True, classes >= 2))])

    def ask_cores(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.filter(table.column("hot"))
        # a row with several occurrences counts twice, which is enough
        times = np.minimum(pc.list_value_length(table.column("doc_ids")).to_numpy(), 2)
        return cm.questions(key[0].as_py(), _all([np.repeat(own[0], times[own[-1]]) for _, _, own in _hot_pieces(table, size, gram)]), cells, DEPTH)

    def pieces(table: pa.Table, told: pa.Table) -> pa.Table:
        return _piece_rows(table.filter(table.column("hot")), told, cells, size, gram)

    told = told_of(chunks.applyInArrow(ask, cm.ASKED_SCHEMA), (2, hot, 65535))
    # runs meet again by chunk in one shuffle, which all that follows reads, as anchors are dear to find
    met_runs = chunks.cogroup(told.groupBy("chunk")).applyInArrow(runs, _RUNS).groupBy("chunk")
    by_anchor = met_runs.applyInArrow(lambda table: table.filter(pc.invert(table.column("hot"))), _RUNS).drop("hot").withColumn("n", F.size("doc_ids"))
    judged = by_anchor.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _judge(batches, size, _FOUND_TYPES), _FOUND)

    cores = told_of(met_runs.applyInArrow(ask_cores, cm.ASKED_SCHEMA), (2, 65534, 65535))
    key = ("anchor", "lead", "body")
    hot_runs = met_runs.cogroup(cores.groupBy("chunk")).applyInArrow(pieces, _RUNS).withColumns({"one": F.xxhash64(*key), "two": F.xxhash64(F.lit(1), *key)})
    single = hot_runs.groupBy("anchor", "one", "two").agg(F.first("lead").alias("lead"), F.first("body").alias("body"), F.sum(F.size("doc_ids")).alias("n"))
    ranges = single.select(*key, "one", "two", "n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _judge(batches, size, _PIECE_TYPES), "one long, two long, ranges array<struct<start: int, stop: int>>")
    # occurrences stay packed in the rows of their chunk
    met = hot_runs.select("one", "two", "chunk", "doc_ids", "tags", "starts").join(ranges, ["one", "two"]).drop("one", "two")
    return judged.unionByName(met)


def _ranges(found: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """First and last starts of repeated windows by (doc_id, tag)."""
    parts = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    for docs, tags, starts, ranges in zip(*(found.column(c).to_pylist() for c in ("doc_ids", "tags", "starts", "ranges")), strict=True):
        doc, tag, at = (np.array(x, dtype=np.int64) for x in (docs, tags, starts))
        parts += [(doc, tag, at + r["start"], at + r["stop"]) for r in ranges]
    doc, tag, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((tag, doc))
    doc, tag, low, high = doc[by], tag[by], low[by], high[by]
    edges = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(tag) != 0))).tolist() if len(doc) else []
    return {(int(doc[a]), int(tag[a])): (low[a:b], high[a:b]) for a, b in zip(edges, [*edges, len(doc)][1:], strict=True)}


def _kept(table: pa.Table, found: pa.Table, size: int) -> pa.Table:
    """What is left of every text of a chunk; a text with copies occurs elsewhere as a whole."""
    ranges = _ranges(found)
    names = list(zip(table.column("doc_id").fill_null(-1).to_pylist(), table.column("tag").to_pylist(), strict=True))
    copies = table.column("copies").to_pylist()
    n_bytes, n_removed, n_spans, digests = [], [], [], []
    for row, data, starts in bs.slices(table.column("text")):
        for i in range(len(starts) - 1):
            mine = data[starts[i] : starts[i + 1] - 1]
            gone = np.full(len(mine), copies[row + i] > 1 and len(mine) >= size)
            if names[row + i] in ranges:
                low, high = ranges[names[row + i]]
                gone |= bs.covered(len(mine), low, high - low + size)
            kept = mine[~gone]
            n_bytes.append(len(mine))
            n_removed.append(len(mine) - len(kept))
            n_spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
    columns = [table.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string()), table.column("copies")]
    return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "copies"])


def suffix_dedup(spark: SparkSession, docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, SHA-256 of the bytes kept."""
    total = cm.text_bytes(docs)
    dealt = deal(docs, total, CHUNK_BYTES, nameless=True)
    found = repeated_ranges(dealt, total, size, gram, hot)
    rows = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda table, ranges: _kept(table, ranges, size), f"{_KEPT}, copies long")
    return repeat(rows)
