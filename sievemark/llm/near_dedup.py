"""Near-duplicate documents: an exact Jaccard join of word-shingle sets with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct ``SHINGLE``-word shingles. Documents with equal sets
form one node from the start. Two nodes link when their sets' Jaccard similarity is ``num / den`` or more, that
is when they differ in at most a ninth of the sum of their sizes (for four fifths).

Candidates come from prefixes. All sets are ordered alike, rarest shingles first; linked sets share a shingle in
their first n - ceil(n * num / den) + 1 ones. How rare a shingle is comes from a count-min sketch, which never puts it
below its true count. The sketch grows with the corpus: chunks of documents send their cells to owners of ranges of
cells and are told the classes of the merged counts; nothing is broadcast. Shingles that occur once can't be shared, so a set with enough of them in
its prefix sends nothing, and other sets send the rest of their prefix with positions: an inverted index.

Index lists aren't paired off.

1. Stars. Every list takes its most central entry as pivot, and every entry is compared with the pivot it shares
   most lists with, unless sizes, positions or 256 parity bits rule a link out. Nodes that differ in less than
   twice what a link allows form the pivot's star; what they add to the pivot and what they lack is known then.
2. Stars meet stars. A list is cut into blocks by star, size class and position (before or after the first ninth
   of the set), and only blocks that a link can join are joined; blocks late in both sets are skipped whole. A pair
   of pivots whose distance exceeds what their members' own distances can bridge is done with. For the others the
   members of the smaller star are compared with the other pivot, as its guests.
3. Within a star, answers come from the differences. Two nodes differ at least in what either alone adds to the
   pivot or alone lacks, and in the difference of the rest. Members are dealt to cells by these two numbers, cells
   that can't hold a link are skipped, and pairs of the others are compared on whole sets. Members linked to the
   pivot are in one component and aren't compared with each other.

Lists, stars, cells and pairs are tables, and no step is repeated: the number of jobs doesn't follow the data. A
pivot with many partners is copied, so that they are spread over tasks.

A null or empty text has an empty set: its component is its own doc_id. Rows that repeat a doc_id are one
document, with the largest of their sets (of equally large ones the one whose fingerprint is larger); each row
keeps its own n_shingles. A null doc_id gets a null component, and links nothing. Columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, plain_constraints
from . import bytescan as bs
from . import countmin as cm
from .chunks import deal, repeat
from .components import components

SHINGLE = 5
NUM, DEN = 4, 5
#: Pairs of one pivot that meet one copy of its set.
FAN = 1024
#: Cells of a star along its pivot's size.
STEPS = 24
#: Documents whose ids, 8 bytes each, may be broadcast to pick their texts.
BROADCAST_IDS = 1 << 19
#: Cells of the sketch for each shingle expected.
CELLS = 2
_BITS = ("b0", "b1", "b2", "b3")
_MEMBERS = "doc_id long, copies long, n_shingles long, sid binary, lead int, prefix array<long>, bits struct<b0: long, b1: long, b2: long, b3: long>"


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text of a slice, ascending within it, and the bounds of each text's."""
    data = bs.LOWER[data]
    a, b = bs.word_bounds(data, bs.SPACE_WORDS)
    words = bs.span_hashes(data, a, b)
    owner = bs.documents_of(starts, a)
    n = len(starts) - 1
    at = np.flatnonzero(owner[: max(len(words) - size + 1, 0)] == owner[size - 1 :])
    keys, docs = [bs.window_hashes(words, size, 11)[at]], [owner[at]]
    first = bs.per_document(owner, n)
    counts = np.diff(first)
    for short in range(1, size):  # too short for a shingle: the whole sequence is one
        few = np.flatnonzero(counts == short)
        if len(few):
            keys.append(bs.window_hashes_at(words, first[few], short, 20 + short))
            docs.append(few)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
    key, doc = key[new], doc[new]
    return key, bs.per_document(doc, n)


def _tokens(column: pa.ChunkedArray) -> np.ndarray:
    """The shingles of every set."""
    return np.concatenate([np.zeros(0, np.uint64), *(shingle_sets(data, starts)[0] for _, data, starts in bs.slices(column))])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def parities(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """256 bits for every set: whether an odd number of its shingles falls on the bit.

    Two sets differ in at least as many shingles as their bits differ.
    """
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    odd = np.bincount(owner * 256 + (key >> np.uint64(9) & np.uint64(255)).astype(np.int64), minlength=n * 256) % 2
    return np.packbits(odd.astype(np.uint8).reshape(n, 256), axis=1).view(np.int64)


def _members(table: pa.Table, told: pa.Table, cells: int) -> pa.Table:
    """Sizes, fingerprints and prefixes of a chunk's sets."""
    sets = [shingle_sets(data, starts) for _, data, starts in bs.slices(table.column("text"))]
    classes = cm.classes(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in sets)]), told, cells, 1)  # once, rare, frequent, very frequent
    done = 0
    sizes, sids, leads, prefixes, bits = [], [], [], [], [np.zeros((0, 4), np.int64)]
    for key, bounds in sets:
        n = np.diff(bounds)
        sids += _fingerprints(key, bounds)
        sizes.append(n)
        bits.append(parities(key, bounds))
        rank = classes[done : done + len(key)]
        done += len(key)
        length = n - -(-n * NUM // DEN) + 1
        lead = _sums((rank == 0).astype(np.uint64), bounds).astype(np.int64)
        for d in range(len(n)):
            if lead[d] >= length[d] or not n[d]:
                leads.append(0)
                prefixes.append(None)
                continue
            own, ranks = key[bounds[d] : bounds[d + 1]], rank[bounds[d] : bounds[d + 1]]
            order = np.lexsort((own, ranks))[lead[d] : length[d]]
            leads.append(int(lead[d]))
            prefixes.append(own[order].view(np.int64))
    return pa.table(
        [
            table.column("doc_id"),
            table.column("copies"),
            pa.array(np.concatenate(sizes) if sizes else np.zeros(0), pa.int64()),
            pa.array(sids, pa.binary()),
            pa.array(leads, pa.int32()),
            pa.array(prefixes, pa.list_(pa.int64())),
            pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(bits).T], names=list(_BITS)),
        ],
        names=["doc_id", "copies", "n_shingles", "sid", "lead", "prefix", "bits"],
    )


def _fingerprints(key: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of every set, whatever the order of its shingles."""
    two = (_sums(bs.mix(key), bounds), _sums(bs.mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds))
    return [x.tobytes() for x in np.stack(two, axis=1)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, sids = [], []
        for _, data, starts in bs.slices(batch.column("text")):
            key, bounds = shingle_sets(data, starts)
            sids += _fingerprints(key, bounds)
            sets += [key[a:b].view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "sid", "items"])


def _allowed(a: Column, b: Column) -> Column:
    """In how many shingles linked sets of these sizes may differ: a ninth of the sum for four fifths."""
    return F.floor((a + b) * (DEN - NUM) / (NUM + DEN))


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) with both sets; the set of an ``a`` with many pairs is copied for each ``FAN`` of them."""
    pairs = cut(pairs)
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
    left = sets.join(fans, F.col("node") == F.col("a")).select("a", F.col("items").alias("left"), F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))
    dealt = pairs.join(fans, "a").withColumn("fan", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int")).drop("fans")
    return dealt.join(right, "b").join(left, ["a", "fan"]).drop("fan")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, added, lacked) of pairs of nodes: how many shingles b has and a hasn't, and the other way round."""
    shared = F.size(F.array_intersect("left", "right"))
    return _met(pairs.select("a", "b"), sets).select("a", "b", (F.size("right") - shared).alias("added"), (F.size("left") - shared).alias("lacked"), (F.size("left") + F.size("right")).alias("both"))


def _linked() -> Column:
    return (F.col("added") + F.col("lacked")) * (NUM + DEN) <= F.col("both") * (DEN - NUM)


def _bits_apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in _BITS), F.lit(0))


def _size_class(n: Column) -> Column:
    """Linked sets are in the same class or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(DEN / NUM))).cast("int")


def _star_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): stars of which a list's blocks may hold a link; ``entries`` are token, star, component, n, pos."""
    early = F.col("pos") * (NUM + DEN) <= F.col("n") * (DEN - NUM)
    blocks = entries.groupBy("token", "star", _size_class(F.col("n")).alias("of_size"), early.alias("early")).agg(
        F.min("pos").alias("pos"), F.max("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    # the first common shingle of linked sets lies in the first ninth of one of them
    own = blocks.where("early").select("token", "of_size", *(F.col(x).alias(f"own_{x}") for x in ("star", "pos", "n", "low", "high")))
    other = blocks.withColumn("of_size", F.explode(F.array(F.col("of_size") - 1, F.col("of_size"), F.col("of_size") + 1)))
    apart = "star <> own_star AND NOT (low = high AND own_low = own_high AND low = own_low)"
    met = other.join(own, ["token", "of_size"]).where(apart).where(F.col("pos") + F.col("own_pos") <= _allowed(F.col("n"), F.col("own_n")))
    return met.select(F.least("star", "own_star").alias("a"), F.greatest("star", "own_star").alias("b")).distinct()


def _within_stars(members: DataFrame, sets: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b): pairs of a star's members, one at least its own, that may link and aren't in one component.

    ``members`` are star, node, own (or a guest) and component; pivots themselves are left out.
    """
    split = members.groupBy("star").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("own").alias("any")).where("low <> high AND any").select("star")
    members = cut(members.join(split, "star"))
    deltas = _met(members.select(F.col("star").alias("a"), F.col("node").alias("b")), sets)
    deltas = cut(deltas.select(F.col("a").alias("star"), F.col("b").alias("node"), F.size("right").alias("n"), F.size("left").alias("star_n"), F.array_except("right", "left").alias("more"), F.array_except("left", "right").alias("less")))
    tokens = deltas.select("star", "node", F.explode("more").alias("token"), F.lit(1).alias("more")).union(deltas.select("star", "node", F.explode("less").alias("token"), F.lit(0).alias("more")))
    alone = tokens.groupBy("star", "token").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node"), F.min("more").alias("more")).where("times = 1")
    alone = alone.groupBy("star", "node").agg(F.sum("more").alias("only_more"), F.sum(1 - F.col("more")).alias("only_less"))
    known = members.join(deltas, ["star", "node"]).join(alone, ["star", "node"], "left").na.fill(0, ["only_more", "only_less"])
    known = known.select("star", "node", "own", "component", "n", "star_n", (F.col("only_more") + F.col("only_less")).alias("only"), (F.size("more") - F.col("only_more")).alias("more"), (F.size("less") - F.col("only_less")).alias("less"))
    width = F.greatest(F.lit(1), F.floor(F.col("star_n") / STEPS))
    known = known.withColumns({"width": width, "i": F.floor(F.col("only") / width), "j": F.floor((F.col("more") + F.col("less")) / width)})
    known = cut(known.where(F.col("only") <= F.floor(F.col("n") * (DEN + NUM) / NUM * (DEN - NUM) / (DEN + NUM))).join(bits, "node"))

    # cells that can hold a link, then their members
    cells = known.groupBy("star", "width", "i", "j").agg(F.max("n").alias("n"), F.max("own").alias("own"), F.min("component").alias("low"), F.max("component").alias("high"))
    names = ("i", "j", "n", "own", "low", "high")
    pairs = cells.join(cells.select("star", *(F.col(x).alias(f"of_{x}") for x in names)), "star").where("own AND NOT (low = high AND of_low = of_high AND low = of_low)")
    least = (F.col("i") + F.col("of_i") + F.greatest(F.lit(0), F.abs(F.col("j") - F.col("of_j")) - 1)) * F.col("width")
    pairs = pairs.where(least <= _allowed(F.col("n"), F.col("of_n"))).select("star", "i", "j", "of_i", "of_j")
    columns = ("node", "component", "n", "only", "more", "less", "bits")
    one = known.where("own").join(pairs, ["star", "i", "j"]).select("star", F.col("of_i").alias("i"), F.col("of_j").alias("j"), *(F.col(x).alias(f"of_{x}") for x in columns))
    differ = F.col("only") + F.col("of_only") + F.abs(F.col("more") - F.col("of_more")) + F.abs(F.col("less") - F.col("of_less"))
    may = _allowed(F.col("n"), F.col("of_n"))
    met = one.join(known, ["star", "i", "j"]).where("node <> of_node AND component <> of_component").where((differ <= may) & (_bits_apart("bits", "of_bits") <= may))
    return met.select(F.least("node", "of_node").alias("a"), F.greatest("node", "of_node").alias("b")).distinct()


def near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    with plain_constraints(spark):
        return _near_classes(spark, docs)


def _near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    size = cm.text_bytes(docs)
    cells = cm.growing_cells(size // 6, CELLS)
    chunks = deal(docs, size).groupBy("chunk")

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return cm.questions(key[0].as_py(), _tokens(table.column("text")), cells, 1)

    def members_of(table: pa.Table, told: pa.Table) -> pa.Table:
        return _members(table, told, cells)

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(shingle_sets(data, starts)[1]) for _, data, starts in bs.slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]))], names=["doc_id", "n_shingles"])

    told = chunks.applyInArrow(sketch, cm.ASKED_SCHEMA).groupBy("owner").applyInArrow(lambda table: cm.answers(table), cm.TOLD_SCHEMA)
    members = cut(chunks.cogroup(told.groupBy("chunk")).applyInArrow(members_of, _MEMBERS))
    unnamed = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(nameless, "doc_id long, n_shingles long")
    own = members.where("n_shingles > 0").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "sid")).alias("s")).select("doc_id", F.col("s.sid").alias("sid"))
    nodes = own.groupBy("sid").agg(F.min("doc_id").alias("node"))
    index = members.where("prefix IS NOT NULL").join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "sid"]).dropDuplicates(["doc_id"])
    index = index.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "lead", "bits", "prefix")
    # sets with few shingles of their own are central: copies differ from each other more than from their original
    edge = F.floor(F.col("lead") * 1000 / F.col("n")).cast("int").alias("edge")
    lists = index.select("node", "n", "lead", edge, "bits", F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", (F.col("at") + F.col("lead")).alias("pos"), "edge", "bits")
    centres = lists.groupBy("token").agg(F.min(F.struct("edge", "node", "n", "pos", "bits")).alias("p"), F.count(F.lit(1)).alias("entries")).where("entries > 1")
    lists = cut(lists.join(centres, "token").select("token", "node", "n", "pos", "bits", *(F.col(f"p.{x}").alias(y) for x, y in (("node", "pivot"), ("n", "pivot_n"), ("pos", "pivot_pos"), ("bits", "pivot_bits")))))
    wanted = lists.select(F.col("node").alias("id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_sets, "node long, sid binary, items array<long>")
    sets = cut(sets.groupBy("node").agg(F.max_by("items", F.struct(F.size("items"), F.col("sid"))).alias("items")))

    # stars: of each entry's pivots, the one that shares most lists with it
    may = _allowed(F.col("n"), F.col("pivot_n"))
    close = (F.least("n", "pivot_n") * DEN >= F.greatest("n", "pivot_n") * NUM) & (F.col("pos") + F.col("pivot_pos") <= 2 * may) & (_bits_apart("bits", "pivot_bits") <= 2 * may)
    best = lists.where("node <> pivot").where(close).groupBy(F.col("node").alias("b"), F.col("pivot").alias("a")).agg(F.count(F.lit(1)).alias("lists"))
    best = best.groupBy("b").agg(F.max(F.struct("lists", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    seen = cut(_verify(best, sets))
    links = seen.where(_linked()).select("a", "b")
    labels = components(links)
    near = seen.where((F.col("added") + F.col("lacked")) * (NUM + DEN) <= F.col("both") * 2 * (DEN - NUM))
    stars = near.select(F.col("b").alias("node"), F.col("a").alias("star"), (F.col("added") + F.col("lacked")).alias("far"), _linked().alias("linked"))
    held = lists.select("token", "node", "n", "pos").join(stars.drop("linked"), "node", "left").join(labels, "node", "left")
    held = held.withColumns({"star": F.coalesce("star", "node"), "far": F.coalesce("far", F.lit(0)), "component": F.coalesce("component", "node")})
    alive = held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    held = cut(held.join(alive, "token"))

    # stars meet stars: guests are the members of one that the pivot of the other may be near
    bits = cut(index.select("node", "n", "bits"))
    reach = cut(held.groupBy("star").agg(F.max("far").alias("far"), F.max("n").alias("n"), F.countDistinct("node").alias("members")))
    pairs = _star_pairs(held)
    for x in ("a", "b"):
        pairs = pairs.join(reach.select(F.col("star").alias(x), *(F.col(y).alias(f"{x}_{y}") for y in ("far", "n", "members"))), x).join(bits.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits")), x)
    bridge = _allowed(F.col("a_n"), F.col("b_n")) + F.col("a_far") + F.col("b_far")
    pairs = cut(pairs.where(_bits_apart("a_bits", "b_bits") <= bridge).select("a", "b", "a_far", "b_far", "a_members", "b_members", bridge.alias("bridge")))
    met = cut(pairs.join(_verify(pairs, sets), ["a", "b"]))
    links = links.union(met.where(_linked()).select("a", "b"))
    apart = F.col("added") + F.col("lacked")
    open_pairs = met.where((apart <= F.col("bridge")) & ((F.col("a_far") > 0) | (F.col("b_far") > 0)))
    host_a = F.col("a_members") >= F.col("b_members")
    hosts = open_pairs.select(F.when(host_a, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(host_a, F.col("b")).otherwise(F.col("a")).alias("star"), apart.alias("apart"), F.col("bridge"), F.when(host_a, F.col("b_far")).otherwise(F.col("a_far")).alias("most"))
    member = cut(held.select("star", "node", "far", "component").distinct())
    guests = cut(hosts.join(member, "star").where("node <> host AND apart - far <= bridge - most").select("host", "node", "component"))
    compared = cut(_verify(guests.select(F.col("host").alias("a"), F.col("node").alias("b")), sets))
    links = links.union(compared.where(_linked()).select("a", "b"))
    guests = guests.join(compared.select(F.col("a").alias("host"), F.col("b").alias("node"), _linked().alias("linked")), ["host", "node"])

    # within stars: linked members share the pivot's component
    of_star = labels.select(F.col("node").alias("star"), F.col("component").alias("of_star"))
    within = member.where("far > 0").select("star", "node", "component", F.lit(True).alias("own"), F.lit(False).alias("linked"))
    within = within.union(guests.select(F.col("host").alias("star"), "node", "component", F.lit(False), "linked")).join(of_star, "star", "left")
    within = within.withColumn("component", F.when(F.col("linked"), F.coalesce("of_star", "star")).otherwise(F.col("component"))).select("star", "node", "own", "component")
    inside = _verify(_within_stars(cut(within), sets, bits.drop("n")), sets)
    labels = components(cut(links.union(inside.where(_linked()).select("a", "b"))))
    named = own.join(nodes, "sid").join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    out = repeat(members.select("doc_id", "n_shingles", "copies").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(unnamed.withColumn("component_id", F.lit(None).cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    Of rows that repeat a doc_id that stays, the one with the longest text stays, of equally long ones the greatest
    text; rows without a doc_id stay.
    """
    classes = near_classes(spark, docs)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = cut(classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left.select(docs.columns)
    rows = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), F.struct(F.length("text"), F.col("text"))).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(rows.select("row.*"))
