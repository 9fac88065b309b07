"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition of documents fingerprints its normalised texts (64 bits), sorts the distinct fingerprints and sends
   every owner its hash range as Golomb-Rice coded gaps. A text held twice in the partition is marked there. A
   partition of more than ``MESSAGE_KEYS`` documents sends in several turns, so that it never holds more of them.
2. Each owner decodes its messages, finds fingerprints sent more than once, and returns one bitmap to each sender.
3. Documents whose bit is set (or that were marked) are suspects. Only their texts are shuffled, and texts are
   grouped by their bytes, so equal fingerprints of different texts part again.

The ledger of a message (doc_ids and SHA-256 in message order, about 45 bytes a document) is written once to the
shared checkpoint folder, so messages and bitmaps stay matched when executors are lost. Owners are as many as
``OWNER_KEYS`` documents each need; a turn sends a fingerprint once, so a text that a third of all documents
hold adds one entry for a turn. Text groups are aggregated before they are shuffled; the join that hands the
result back to the members is on a key that AQE may split.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id
stays; a null doc_id loses to any other and stays only among nulls. Repeated rows are copies with one doc_id;
all rows of the doc_id that stays are marked kept. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import bytescan as bs

OWNER_KEYS = 1 << 20
#: Documents of a partition, by about 60 bytes each, whose fingerprints are sent in one turn.
MESSAGE_KEYS = 1 << 19
#: Suspects, by 16 bytes each, that may be broadcast to pick their texts out of the corpus.
BROADCAST_SUSPECTS = 1 << 19
_LEDGER = "owner int, sender binary, coded binary, rice int, n int, places array<int>, doc_ids array<long>, shas array<binary>, marked array<boolean>"


def golomb_encode(values: np.ndarray, rice: int) -> bytes:
    """Ascending 64-bit values as Golomb-Rice codes of their gaps with ``rice`` low bits."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(rice)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 1
    low = gaps & np.uint64((1 << rice) - 1)
    bits = (low[:, None] >> np.arange(rice, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary, bitorder="little").tobytes()
    return len(head).to_bytes(4, "little") + head + np.packbits(bits.ravel(), bitorder="little").tobytes()


def golomb_decode(coded: bytes, n: int, rice: int) -> np.ndarray:
    """The inverse of ``golomb_encode``."""
    if not n:
        return np.zeros(0, np.uint64)
    size = int.from_bytes(coded[:4], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(coded[4 : 4 + size], np.uint8), bitorder="little"))[:n]
    quotient = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(coded[4 + size :], np.uint8), bitorder="little")[: n * rice].reshape(n, rice)
    low = (bits.astype(np.uint64) << np.arange(rice, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient << np.uint64(rice)) | low, dtype=np.uint64)


def rice_bits(n: int, width: int) -> int:
    """Low bits that suit ``n`` values spread over ``width`` bits."""
    return max(0, min(width, width - max(n, 1).bit_length() + 1))


def normalise(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return bs.LOWER[data]


def _fingerprints(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    prints, shas = [], []
    for _, data, starts in bs.slices(batch.column("text")):
        data = normalise(data)
        prints.append(bs.span_hashes(data, starts[:-1], starts[1:] - 1))
        raw = memoryview(data.tobytes())
        shas += [hashlib.sha256(raw[a:b]).digest() for a, b in zip(starts[:-1].tolist(), (starts[1:] - 1).tolist(), strict=True)]
    return np.concatenate(prints) if prints else np.zeros(0, np.uint64), shas


def _messages(prints: np.ndarray, ids: pa.Array, shas: pa.Array, sender: bytes, owners: int) -> pa.RecordBatch:
    """A message for each owner that has fingerprints here, and the documents behind it in the message's order."""
    width = np.uint64((1 << 64) // owners + 1) if owners > 1 else None
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    owner = (prints // width).astype(np.int64) if width is not None else np.zeros(len(prints), np.int64)
    # fingerprints are in order, so an owner's are next to each other; owners without one cost nothing
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    bounds = np.append(starts, len(owner))
    present = owner[starts]
    coded, bits, sizes = [], [], []
    places, marked = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for o, a, b in zip(present.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values, place, counts = np.unique(prints[a:b], return_inverse=True, return_counts=True)
        rice = rice_bits(len(values), 64 - max(owners - 1, 0).bit_length())
        coded.append(golomb_encode(values - (np.uint64(o) * width if width is not None else np.uint64(0)), rice))
        bits.append(rice)
        sizes.append(len(values))
        places.append(place)
        marked.append(counts[place] > 1)
    offsets, taken = pa.array(bounds, pa.int32()), pa.array(order)
    told = (pa.array(np.concatenate(places), pa.int32()), ids.take(taken), shas.take(taken), pa.array(np.concatenate(marked)))
    plain = (pa.array(present, pa.int32()), pa.array([sender] * len(present), pa.binary()), pa.array(coded, pa.binary()), pa.array(bits, pa.int32()), pa.array(sizes, pa.int32()))
    names = ["owner", "sender", "coded", "rice", "n", "places", "doc_ids", "shas", "marked"]
    return pa.RecordBatch.from_arrays([*plain, *(pa.ListArray.from_arrays(offsets, x) for x in told)], names=names)


def _ledger(batches: Iterator[pa.RecordBatch], owners: int, most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    prints: list[np.ndarray] = []
    ids: list[pa.Array] = []
    shas: list[pa.Array] = []
    turn = 0

    def send() -> pa.RecordBatch:
        sender = f"{TaskContext.get().partitionId()}/{turn}".encode()
        return _messages(np.concatenate(prints), pa.concat_arrays(ids), pa.concat_arrays(shas), sender, owners)

    for batch in batches:
        own, digests = _fingerprints(batch)
        prints.append(own)
        ids.append(batch.column("doc_id").cast(pa.int64()))
        shas.append(pa.array(digests, pa.binary()))
        if sum(map(len, prints)) >= most:
            yield send()
            prints, ids, shas, turn = [], [], [], turn + 1
    if sum(map(len, prints)):
        yield send()


def _answer(table: pa.Table) -> pa.Table:
    """Bitmaps of fingerprints that more than one message holds."""
    lists = [golomb_decode(c, n, r) for c, n, r in zip(table.column("coded").to_pylist(), table.column("n").to_pylist(), table.column("rice").to_pylist(), strict=True)]
    everything = np.concatenate(lists)
    values, counts = np.unique(everything, return_counts=True)
    twice = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, twice), bitorder="little").tobytes() for x in lists]
    return pa.table({"owner": table.column("owner"), "sender": table.column("sender"), "bitmap": pa.array(bitmaps, pa.binary())})


def exact_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select("doc_id", "text")
    n, most = docs.count(), MESSAGE_KEYS
    owners = max(1, -(-n // OWNER_KEYS), min(64, n // 4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ledger = cut(docs.mapInArrow(lambda batches: _ledger(batches, owners, most), _LEDGER))
    answers = ledger.select("owner", "sender", "coded", "rice", "n").groupBy("owner").applyInArrow(_answer, "owner int, sender binary, bitmap binary")
    told = ledger.drop("coded", "rice", "n").join(answers, ["owner", "sender"])
    member = F.explode(F.arrays_zip("places", "doc_ids", "shas", "marked")).alias("m")
    # bit number `places` of the bitmap, low bits first
    octet = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("m.places") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    members = told.select("bitmap", member).withColumn("octet", octet)
    said = F.expr("shiftright(octet, m.places % 8) % 2 = 1")
    members = members.select(F.col("m.doc_ids").alias("doc_id"), F.col("m.shas").alias("sha"), (F.col("m.marked") | said).alias("suspect"))
    members = cut(members)
    wanted = members.where("suspect").select(F.coalesce("doc_id", F.lit(-1)).alias("id")).distinct()
    if wanted.count() <= BROADCAST_SUSPECTS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.coalesce("doc_id", F.lit(-1)) == F.col("id"), "left_semi")

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, data, starts in bs.slices(batch.column("text")):
                raw = normalise(data).tobytes()
                rows += [raw[a:b] for a, b in zip(starts[:-1].tolist(), (starts[1:] - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.sha256(x).digest() for x in rows], pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "sha", "body"])

    # one group for each distinct text, by its bytes; its members are then told by SHA-256, unless one
    # SHA-256 had several texts, which the count of bodies would show
    classes = texts.mapInArrow(normal, "doc_id long, sha binary, body binary").groupBy("sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("bodies"))
    checked = F.when(F.col("bodies") > 1, F.raise_error("one SHA-256 for different texts").cast("long")).otherwise(F.col("group_size"))
    classes = classes.select(F.col("sha").alias("class"), F.col("keep_id").alias("largest"), checked.alias("size"))
    out = members.join(classes, members["suspect"] & (members["sha"] == classes["class"]), "left")
    keep = F.coalesce("largest", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays.

    Rows of a doc_id that occurs once are told by it. Rows of a repeated or null doc_id, if there are any, are told
    by their normalised text too.
    """
    classes = cut(exact_classes(spark, docs))
    ids = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("kept")).alias("gone"))
    plain = docs.join(ids.where("n > 1 OR gone").select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_anti").where("doc_id IS NOT NULL")
    several = ids.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    if several.isEmpty():
        return plain
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    own = docs.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumn("_sha", F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256))
    kept = classes.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text")).distinct()
    own = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_text")), "left_semi")
    return plain.unionByName(own.dropDuplicates(["doc_id", "_sha"]).drop("_sha"))
