"""Readers and writers of the file forms around a panel: JSON lines, CSV, endpoint trees, file digests."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json, git_blob_sha1
from ..operators import gates
from ..session import cut

# fixed values: fields of the files, by name
HUMAN = "source_id string, compact_index int, raw_row_index int, raw_label int, split_origin string, human_text string, human_sha256 string, human_word_count int, topic string, topic_sha256 string, low_words int, high_words int"
QUEUE = "source_id string, compact_index int, split_origin string, cohort string, human_sha256 string, topic string, topic_sha256 string, target_words int, low_words int, high_words int"
ENDPOINT = (
    "contract_sha256 string, run_id string, suite string, cell string, cohort string, phase string, model_hf_id string, model_revision string, source_id string, human_sha256 string, topic_sha256 string, "
    "compact_index int, split_origin string, attempt int, status string, output_tokens int, output_token_ids array<int>, exact_token_count boolean, raw_output string, normalized_output string, "
    "raw_output_sha256 string, normalized_output_sha256 string, prompt_sha256 string, actual_words int"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a fixed schema, one a line; blank lines are skipped, anything else stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One canonical object a line: sorted names, no spaces, nulls kept."""
    df.select(canonical_json(*df.columns).alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header that must have the schema's columns."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', enforceSchema=False, mode="FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, escape='"').csv(path)


#: Splits of files, about 100 bytes each, whose first row numbers may be broadcast; more of them meet rows in a join.
BROADCAST_SPLITS = 1 << 20


def numbered_rows(read: DataFrame) -> DataFrame:
    """Rows of a file source with ``file``, ``row`` in the file and ``place`` over all files by name, from 0.

    A first pass counts the rows of every split, the counts are summed up in the order of files and offsets, and a
    second pass adds them to the places within a split. Rows aren't sorted or moved. What a reader skips (headers,
    blank lines of CSV) has no number. The two passes have to plan the same splits: files mustn't change between them.
    """
    rows = read.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    splits = cut(splits)
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "_block", "_first", before(Window.partitionBy("file").orderBy("_block")).alias("_row"))
    of_file = splits.groupBy("file").agg(F.sum("_n").alias("_n"))
    # a row for each file
    offsets = offsets.join(of_file.select("file", before(Window.orderBy("file")).alias("_place")), "file")
    offsets = F.broadcast(offsets) if splits.count() <= BROADCAST_SPLITS else offsets
    own = F.col("_at") - F.col("_first") + F.col("_row")
    return rows.join(offsets, ["file", "_block"]).select(*[F.col(c) for c in read.columns], "file", own.alias("row"), (own + F.col("_place")).alias("place"))


def first_rows(numbered: DataFrame, n: int) -> DataFrame:
    """The first n rows over all files, by number, as a reader with a limit takes them."""
    return numbered.where(F.col("place") < n)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Objects of a schema with ``file`` and ``line`` from 1, and the lines (file, line, place, reason, value) that aren't.

    Blank lines count but give no row. Reasons: ``broken`` (no JSON, or a name twice), ``not an object``, ``fields``
    (a field isn't of its type). All lines are told, not only the first.
    """
    lines = numbered_rows(spark.read.text(path)).where(~F.col("value").rlike(r"\A\s*\z"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    kind = F.schema_of_variant(F.try_parse_json("value"))
    reason = F.when(kind.isNull(), "broken").when(~kind.startswith("OBJECT"), "not an object").when(F.col("_parsed._bad").isNotNull(), "fields")
    told = lines.withColumn("_parsed", parsed).withColumn("reason", reason)
    line = (F.col("row") + 1).alias("line")
    fields = [f.name for f in told.schema["_parsed"].dataType.fields if f.name != "_bad"]
    good = told.where("reason IS NULL").select(*(F.col("_parsed")[f].alias(f) for f in fields), "file", line)
    return good, told.where("reason IS NOT NULL").select("file", line, "place", "reason", "value")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files, one row each, with their path."""
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def read_endpoints(spark: SparkSession, root: str, schema: str = ENDPOINT) -> DataFrame:
    """Attempts of a cell directory (source folder / attempt-NN.json), with folder and file from the path."""
    rows = spark.read.schema(schema).options(multiLine=True, mode="FAILFAST", pathGlobFilter="attempt-*.json").json(f"{root}/*/")
    path = F.col("_metadata.file_path")
    return rows.withColumn("folder", F.regexp_extract(path, r"([^/]+)/attempt-[^/]*$", 1)).withColumn("file", F.regexp_extract(path, r"([^/]+)$", 1))


def only_first_attempts(endpoints: DataFrame) -> DataFrame:
    """Folders whose files aren't exactly attempt-00.json."""
    return endpoints.groupBy("folder").agg(F.array_sort(F.collect_list("file")).alias("files")).where(F.col("files") != F.array(F.lit("attempt-00.json")))


def file_digests(spark: SparkSession, path: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """name, length, sha256 and git blob sha1 of the files below a path; a file is one cell, 2 GiB at most."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return rows.where(~F.col("name").isin(*ignore)).select("name", "length", F.sha2("content", 256).alias("sha256"), git_blob_sha1("content").alias("sha1"))


def read_parameters(spark: SparkSession, path: str) -> dict:
    """A small JSON document of parameters, read through Spark so that any store works."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_result(df: DataFrame, path: str) -> None:
    """A result of one row as one indented JSON document, written by Spark, so that any store works."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    rows.coalesce(1).write.text(path)


def first_present(parameters: dict, *paths: str):
    """The value at the first of some dotted paths that a result document has, as its key names changed over time."""
    for path in paths:
        value = parameters
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        if value is not None:
            return value
    raise KeyError(paths)


def flattened(parameters: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, JSON value) of every leaf of a document."""
    out: list[tuple[str, str]] = []
    for k, v in sorted(parameters.items()):
        at = f"{prefix}.{k}" if prefix else k
        out += flattened(v, at) if isinstance(v, dict) and v else [(at, json.dumps(v, sort_keys=True))]
    return out


def with_view_length(parameters: dict, tokens: int) -> dict:
    """Parameters of a run on a shorter view: only the representation's length differs."""
    shape = parameters.get("representation", {})
    return {**parameters, "representation": {**shape, "content_tokens": tokens}}


def changed_paths(a: dict, b: dict) -> list[str]:
    """Paths at which two documents differ."""
    x, y = dict(flattened(a)), dict(flattened(b))
    return sorted(k for k in x.keys() | y.keys() if x.get(k) != y.get(k))


_CHUNK = 1 << 20


def directory_digests(spark: SparkSession, directory: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """name, length, regular, symlink_target, resolved_folder, sha256 and git sha1 of a directory's entries, of any size.

    Names are listed by the driver; each file is read in pieces of 1 MiB by one task. The directory has to be one that
    all executors see. What isn't a regular file, or a link to one, has no length and no digests.
    """
    entries = []
    for name in sorted(set(os.listdir(directory)) - set(ignore)):
        path = os.path.join(directory, name)
        link = os.readlink(path) if os.path.islink(path) else None
        entries.append((name, path, os.path.isfile(path), link, os.path.dirname(os.path.realpath(path))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, regular in zip(batch.column("path").to_pylist(), batch.column("regular").to_pylist(), strict=True):
                if not regular:
                    out.append((None, None, None))
                    continue
                size = os.path.getsize(path)
                whole, blob = hashlib.sha256(), hashlib.sha1(f"blob {size}\0".encode())
                with open(path, "rb") as handle:
                    while piece := handle.read(_CHUNK):
                        whole.update(piece)
                        blob.update(piece)
                out.append((size, whole.hexdigest(), blob.hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "regular", "symlink_target", "resolved_folder")), *columns], names=["name", "regular", "symlink_target", "resolved_folder", "length", "sha256", "sha1"])

    rows = spark.createDataFrame(entries, "name string, path string, regular boolean, symlink_target string, resolved_folder string")
    return rows.repartition(max(1, min(len(entries), 1024))).mapInArrow(run, "name string, regular boolean, symlink_target string, resolved_folder string, length long, sha256 string, sha1 string")


def directory_gate(found: DataFrame, pinned: DataFrame, blobs_folder: str | None = None, extra: DataFrame | None = None, gate: str = "weights") -> DataFrame:
    """A directory's entries against pinned files (name, length, sha256, sha1), and none besides.

    A null pinned digest isn't compared, as of files whose sha1 isn't told. ``extra`` are files of the same form that
    may be there as well. Links have to lead into ``blobs_folder`` itself.
    """
    allowed = pinned.withColumn("_needed", F.lit(True))
    if extra is not None:
        allowed = allowed.unionByName(extra.join(pinned.select("name"), "name", "left_anti").withColumn("_needed", F.lit(False)))
    met = found.join(allowed.select("name", F.struct("length", "sha256", "sha1").alias("_pin")), "name")
    p = lambda c: F.col("_pin")[c]
    whole = F.col("regular")
    rules = {
        "regular file": whole,
        "length": (~whole | (F.col("length") == p("length")), F.col("length")),
        "sha256": (~whole | p("sha256").isNull() | (F.col("sha256") == p("sha256")), F.col("sha256")),
        "sha1": (~whole | p("sha1").isNull() | (F.col("sha1") == p("sha1")), F.col("sha1")),
    }
    if blobs_folder is not None:
        rules["link leads outside"] = (F.col("symlink_target").isNull() | (F.col("resolved_folder") == os.path.realpath(blobs_folder)), F.col("symlink_target"))
    absent = gates.coverage(allowed.where("_needed"), found, gate, ["name"]).where("rule = 'missing'")
    stray = gates.coverage(allowed, found, gate, ["name"]).where("rule = 'unexpected'")
    return gates.gather(absent, stray, gates.compiled(met, gate, ["name"], rules))
