"""Queries of file sources: tables written to the shared folder in a form of the panel, read back and held to its rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import configs, text
from ..operators import gates
from ..session import cut, shared_folder
from ..sources import arrays, files
from .catalogue import query
from .tables import MANIFEST_SQL, manifest, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose files, by name, hold them in the order of a key."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


@query("SELECT vec_id, label, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, embedding[1]::DOUBLE AS head, embedding[-1]::DOUBLE AS tail FROM embeddings")
def npz_round_trip(spark, sf_dir):
    """All embeddings as archives of arrays, written and read back."""
    arrays.register(spark)
    path = _folder(spark, "embeddings")
    table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").write.format("arrays").mode("append").save(path)
    back = spark.read.format("arrays").load(path)
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x)
    return back.select("vec_id", "label", F.size("embedding").cast("long").alias("n"), F.round(total, 6).alias("total"), F.element_at(doubles, 1).alias("head"), F.element_at(doubles, -1).alias("tail"))


@query("SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1")
def npz_member_pruning(spark, sf_dir):
    """Two members of such archives by row: each is read alone, and they are joined by file and row."""
    arrays.register(spark)
    path = _folder(spark, "embeddings")
    table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").write.format("arrays").option("rows", 4096).mode("append").save(path)
    member = lambda c: spark.read.format("arrays").schema(f"{c}, _file string, _row long").load(path)
    met = member("vec_id long").join(member("label int"), ["_file", "_row"])
    return met.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


_LINES = """CASE WHEN doc_id % 11 = 3 THEN '' WHEN doc_id % 13 = 2 THEN '[1, 2]' WHEN doc_id % 17 = 5 THEN concat('{"doc_id":', doc_id) WHEN doc_id % 19 = 7 THEN concat('{"doc_id":"x', doc_id, '"}') ELSE concat('{"doc_id":', doc_id, ',"lang":"', coalesce(lang, ''), '"}') END"""


@query(f"WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, {_LINES} AS value FROM documents) SELECT place, CASE WHEN value LIKE '[%' THEN 'not an object' WHEN value NOT LIKE '%}}' THEN 'broken' ELSE 'fields' END AS reason, value FROM t WHERE value <> '' AND (value LIKE '[%' OR value NOT LIKE '%}}' OR value LIKE '%\"x%')")
def jsonl_rejects(spark, sf_dir):
    """JSON lines with blank, broken and other lines put in by number: all lines that are rejected, by place."""
    path = _folder(spark, "lines")
    _in_order(table(spark, sf_dir, "documents").select("doc_id", F.expr(_LINES).alias("value")), "doc_id").select("value").write.text(path)
    return files.read_json_lines(spark, path, "doc_id long, lang string")[1].select("place", "reason", "value")


@query(
    "WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, CASE WHEN doc_id % 37 = 4 THEN 1 - doc_id % 2 ELSE doc_id % 2 END AS generated, doc_id FROM documents WHERE doc_id % 101 <> 60)"
    " SELECT 'csv' AS gate, 'rows' AS rule, count(*)::VARCHAR AS key, '' AS detail FROM t HAVING count(*) <> (SELECT count(*) FROM documents)"
    " UNION ALL SELECT 'csv', 'label', place::VARCHAR, generated::VARCHAR FROM t WHERE generated <> place % 2"
    " UNION ALL SELECT 'csv', 'index', place::VARCHAR, doc_id::VARCHAR FROM t WHERE doc_id <> place"
)
def csv_position_gate(spark, sf_dir):
    """A CSV of alternating labels, with labels turned and rows left out by number, against its positional contract."""
    docs = table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 37 == 4, 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2)
    path = _folder(spark, "csv")
    files.write_csv(_in_order(docs.where("doc_id % 101 <> 60").select("doc_id", label.alias("generated")), "doc_id"), path)
    rows = files.numbered_rows(spark.read.schema("doc_id long, generated int").options(header=True, enforceSchema=False, mode="FAILFAST").csv(path))
    rules = {"label": (F.col("generated") == F.col("place") % 2, F.col("generated")), "index": (F.col("doc_id") == F.col("place"), F.col("doc_id"))}
    return gates.positions(rows, "csv", "place", docs.count(), rules)


@query("SELECT place, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, doc_id FROM documents) WHERE place < 100")
def csv_first_rows(spark, sf_dir):
    """The first 100 rows of a CSV of several files, by their place."""
    path = _folder(spark, "csv")
    files.write_csv(_in_order(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), path)
    return files.first_rows(files.numbered_rows(files.read_csv(spark, path, "doc_id long, lang string")), 100).select("place", "doc_id")


_ZIP = "CASE WHEN compact_index % 23 = 1 THEN 'x' ELSE human_sha256 END AS human_sha256, CASE WHEN compact_index % 29 = 2 THEN -1 ELSE human_word_count END AS human_word_count, CASE WHEN compact_index % 31 = 3 THEN 'dev' ELSE split_origin END AS split_origin"


@query(
    f"WITH {MANIFEST_SQL}, h AS (SELECT row_number() OVER (ORDER BY compact_index) - 1 AS place, source_id, compact_index, human_sha256, human_word_count FROM manifest),"
    f" m AS (SELECT row_number() OVER (ORDER BY compact_index) - 1 AS place, source_id, compact_index, {_ZIP} FROM manifest WHERE compact_index < (SELECT max(compact_index) - 3 FROM manifest)),"
    " b AS (SELECT m.*, h.human_sha256 AS own_sha256, h.human_word_count AS own_words FROM m JOIN h USING (place))"
    " SELECT 'manifest' AS gate, 'left' AS rule, place::VARCHAR AS key, '' AS detail FROM m WHERE place NOT IN (SELECT place FROM h)"
    " UNION ALL SELECT 'manifest', 'right', place::VARCHAR, '' FROM h WHERE place NOT IN (SELECT place FROM m)"
    " UNION ALL SELECT 'manifest', 'identity', place::VARCHAR, source_id FROM b WHERE (source_id = 'arxiv2k:' || CASE WHEN length(place::VARCHAR) < 4 THEN lpad(place::VARCHAR, 4, '0') ELSE place::VARCHAR END AND compact_index = place) IS NOT TRUE"
    " UNION ALL SELECT 'manifest', 'hash', place::VARCHAR, coalesce(human_sha256, 'null') FROM b WHERE (human_sha256 = own_sha256) IS NOT TRUE"
    " UNION ALL SELECT 'manifest', 'words', place::VARCHAR, coalesce(human_word_count::VARCHAR, 'null') FROM b WHERE (human_word_count = own_words) IS NOT TRUE"
    " UNION ALL SELECT 'manifest', 'split', place::VARCHAR, coalesce(split_origin, 'null') FROM b WHERE (split_origin IN ('train', 'val', 'test')) IS NOT TRUE"
)
def positional_zip_gate(spark, sf_dir):
    """A canonical manifest, with faults and missing rows, against the human texts row by row, both read from files."""
    # both files and the last index come from these rows: texts are hashed and counted in one pass
    made = cut(manifest(spark, sf_dir).select("source_id", "compact_index", "human_sha256", "human_word_count", "split_origin"))
    humans, canonical = _folder(spark, "humans"), _folder(spark, "canonical")
    files.write_csv(_in_order(made.select("compact_index", "human_sha256", "human_word_count"), "compact_index"), humans)
    last = made.agg(F.max("compact_index")).first()[0]
    files.write_csv(_in_order(made.where(F.col("compact_index") < (last or 0) - 3).selectExpr("source_id", "compact_index", *_ZIP.replace(" AS human_sha256, ", " AS human_sha256|").replace(" AS human_word_count, ", " AS human_word_count|").split("|")), "compact_index"), canonical)
    own = files.numbered_rows(files.read_csv(spark, humans, "compact_index long, human_sha256 string, human_word_count int")).select("place", "human_sha256", "human_word_count")
    read = files.numbered_rows(files.read_csv(spark, canonical, "source_id string, compact_index long, human_sha256 string, human_word_count int, split_origin string"))
    other = read.select("place", "source_id", "compact_index", F.col("human_sha256").alias("sha"), F.col("human_word_count").alias("words"), "split_origin")
    o = lambda c: F.col("_other")[c]
    rules = {
        "identity": ((o("source_id") == text.source_id("place")) & (o("compact_index") == F.col("place")), o("source_id")),
        "hash": (o("sha") == F.col("human_sha256"), o("sha")),
        "words": (o("words") == F.col("human_word_count"), o("words")),
        "split": (o("split_origin").isin("train", "val", "test"), o("split_origin")),
    }
    return gates.zipped(own, other, "manifest", "place", rules)


_TOPICS = "SELECT CASE WHEN doc_id % 41 = 5 THEN doc_id + 1 ELSE doc_id END AS original_index, CASE WHEN doc_id % 43 = 6 THEN '  ' ELSE source END AS topic, CASE WHEN doc_id % 47 = 7 THEN 'changed' ELSE text END AS original_text FROM documents WHERE text IS NOT NULL AND doc_id % 53 <> 8"


@query(
    f"WITH h AS (SELECT doc_id AS original_index, text FROM documents WHERE text IS NOT NULL), t AS ({_TOPICS}), spots AS (SELECT text, min(original_index) AS place FROM h GROUP BY 1)"
    " SELECT 'topics' AS gate, 'unique' AS rule, original_index::VARCHAR AS key, count(*)::VARCHAR AS detail FROM t GROUP BY original_index HAVING count(*) > 1"
    " UNION ALL SELECT 'topics', 'missing', original_index::VARCHAR, '' FROM h WHERE original_index NOT IN (SELECT original_index FROM t)"
    " UNION ALL SELECT DISTINCT 'topics', 'unexpected', original_index::VARCHAR, '' FROM t WHERE original_index NOT IN (SELECT original_index FROM h)"
    " UNION ALL SELECT 'topics', 'text', t.original_index::VARCHAR, coalesce(spots.place::VARCHAR, 'nowhere') FROM t JOIN h USING (original_index) LEFT JOIN spots ON spots.text = t.original_text WHERE t.original_text <> h.text"
    " UNION ALL SELECT 'topics', 'topic blank', original_index::VARCHAR, '' FROM t WHERE length(trim(topic)) = 0 OR topic IS NULL"
)
def topics_gate(spark, sf_dir):
    """Topics that name a human text by its index and repeat it, with faults put in by number, against the texts both ways."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    number = F.col("doc_id")
    rows = docs.where(number % 53 != 8).select(F.when(number % 41 == 5, number + 1).otherwise(number).alias("original_index"), F.when(number % 43 == 6, "  ").otherwise(F.col("source")).alias("topic"), F.when(number % 47 == 7, "changed").otherwise(F.col("text")).alias("original_text"))
    return gates.matched_texts(rows, docs.select(number.alias("original_index"), "text"), "topics", "original_index", "original_text", "topic")


_CONFIG = """concat('{"run":{"id":', doc_id, ',"lang":"', coalesce(lang, 'none'), '"},"representation":{"content_tokens":', 128 + doc_id % 3, ',"views":[128,64]},"source":"', coalesce(source, ''), '"', CASE WHEN doc_id % 5 = 0 THEN ',"note":{}' ELSE '' END, '}')"""
_SHORTER = """'{' || CASE WHEN doc_id % 5 = 0 THEN '"note":{},' ELSE '' END || '"representation":{"content_tokens":64,"mask":{"boundaries":false},"views":[128,64]},"run":{"id":' || doc_id || ',"lang":"' || coalesce(lang, 'none') || '"},"source":"' || coalesce(source, '') || '"}'"""
_SET = {("representation", "content_tokens"): "64", ("representation", "mask", "boundaries"): "false"}


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.parse_json(F.expr(_CONFIG)).alias("config"))


@query(f"SELECT doc_id, {_SHORTER} AS config FROM documents")
def config_replace(spark, sf_dir):
    """A run's configuration for each document, with its view shortened and a nested field made."""
    made = configs.replaced(_configs(spark, sf_dir), ["doc_id"], "config", {p: F.lit(v) for p, v in _SET.items()})
    return made.select("doc_id", F.to_json("config").alias("config"))


@query(
    "SELECT doc_id, 'representation.content_tokens' AS path, (128 + doc_id % 3)::VARCHAR AS before, '64' AS after FROM documents WHERE doc_id % 3 <> 1"
    " UNION ALL SELECT doc_id, 'representation.mask.boundaries', NULL, 'false' FROM documents WHERE doc_id % 3 <> 1"
    " UNION ALL SELECT doc_id, p, CASE p WHEN 'run.id' THEN doc_id::VARCHAR WHEN 'run.lang' THEN '\"' || coalesce(lang, 'none') || '\"' WHEN 'source' THEN '\"' || coalesce(source, '') || '\"' WHEN 'note' THEN '{}' WHEN 'representation.views' THEN '[128,64]' ELSE (128 + doc_id % 3)::VARCHAR END, NULL"
    " FROM documents, (SELECT unnest(['run.id', 'run.lang', 'source', 'note', 'representation.views', 'representation.content_tokens']) AS p) WHERE doc_id % 3 = 1 AND (p <> 'note' OR doc_id % 5 = 0)"
)
def config_changes(spark, sf_dir):
    """Two folders of configurations, the second shortened and without every third, compared path by path."""
    before = _configs(spark, sf_dir)
    after = configs.replaced(before.where("doc_id % 3 <> 1"), ["doc_id"], "config", {p: F.lit(v) for p, v in _SET.items()})
    found = configs.differences(configs.leaves(before, ["doc_id"], "config"), configs.leaves(after, ["doc_id"], "config"), ["doc_id"])
    return found.select("doc_id", F.array_join("path", ".").alias("path"), F.col("left").alias("before"), F.col("right").alias("after"))
