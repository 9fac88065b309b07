"""The provided tables as a detectability panel: users are sources, event types are cells, one of them the human side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace, word_count
from ..operators.manifests import source_manifest, split_of

HUMAN_CELL = "view"
CELLS = ("click", "error", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, cell, value: each user's total of an event type, in whole cents, so that sums are exact."""
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("cell")).agg(F.sum(cents).alias("value"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, source, human, generated: totals of each cell against the human cell's."""
    rows = blocks(spark, sf_dir)
    human = rows.where(F.col("cell") == HUMAN_CELL).select("source", F.col("value").alias("human"))
    return rows.where(F.col("cell") != HUMAN_CELL).join(human, "source").select("cell", "source", "human", F.col("value").alias("generated"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources: compact_index is the doc_id, splits by hash, the topic is the first line."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("compact_index"), "text", "source", "lang", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("topic"))
    return source_manifest(rows).withColumn("split_origin", split_of(F.col("compact_index"))).withColumn("topic_sha256", F.sha2("topic", 256))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source text of a user's turn and rewritten text of the turn after it."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source_text"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rewritten"))
    return asked.join(answered, ["conv_id", "turn"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """generator (of four), conv_id, words of the question and of the answer: counts that correlate."""
    rows = exchanges(spark, sf_dir)
    own = F.pmod("turn", F.lit(4)).cast("string")
    return rows.select(own.alias("generator"), "conv_id", word_count("source_text").cast("long").alias("asked"), F.length(normalize_whitespace("rewritten")).cast("long").alias("answered"))


# the same in SQL
WHITESPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normal_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITESPACE_SQL}', ' ', 'g'))"


def words_sql(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN {normal_sql(text)} = '' THEN 0 ELSE len(string_split({normal_sql(text)}, ' ')) END"


BLOCKS_SQL = "blocks AS (SELECT user_id AS source, event_type AS cell, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS value FROM events GROUP BY 1, 2)"
SCORES_SQL = f"""{BLOCKS_SQL},
scores AS (SELECT g.cell, g.source, h.value AS human, g.value AS generated FROM blocks g JOIN blocks h ON h.source = g.source AND h.cell = '{HUMAN_CELL}' WHERE g.cell <> '{HUMAN_CELL}')"""
AUROC_SQL = f"""{SCORES_SQL},
won AS (SELECT a.cell, sum(CASE WHEN a.generated > b.human THEN 2 WHEN a.generated = b.human THEN 1 ELSE 0 END)::BIGINT AS twice_wins, count(*) AS pairs
        FROM scores a JOIN scores b ON a.cell = b.cell GROUP BY 1),
auroc AS (SELECT cell, twice_wins, pairs, twice_wins / (2.0 * pairs) AS auroc, twice_wins = 2 * pairs AS ceiling FROM won)"""
SPLIT_SQL = "CASE WHEN (('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT % 1000) / 1000.0 < 0.704 THEN 'train' WHEN (('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT % 1000) / 1000.0 < 0.842 THEN 'val' ELSE 'test' END"
MANIFEST_SQL = f"""manifest AS (
  SELECT doc_id AS compact_index, text, source, lang, split_part(text, chr(10), 1) AS topic, 'arxiv2k:' || CASE WHEN length(doc_id::VARCHAR) < 4 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END AS source_id,
         sha256(text) AS human_sha256, ({words_sql("text")})::INTEGER AS human_word_count, {SPLIT_SQL.format("doc_id")} AS split_origin, sha256(split_part(text, chr(10), 1)) AS topic_sha256
  FROM documents)"""
EXCHANGES_SQL = """exchanges AS (
  SELECT u.conv_id, u.turn, u.text AS source_text, a.text AS rewritten FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' AND u.text IS NOT NULL AND a.text IS NOT NULL)"""
PAIRS_SQL = f"""{EXCHANGES_SQL},
pairs AS (SELECT (turn % 4)::VARCHAR AS generator, conv_id, ({words_sql("source_text")})::BIGINT AS asked, length({normal_sql("rewritten")})::BIGINT AS answered FROM exchanges)"""


def merkle_sql(rows: str, levels: int = 6) -> str:
    """CTEs l0 (place, hash, path) to the root's level of the tree over ``rows`` (path, digest), and f1, f2, ... (place, family) between them.

    A level of one row stays as it is, so that the last one is the root up to 16 ** levels rows.
    """
    out = f"""l0 AS (SELECT row_number() OVER (ORDER BY path, hash) - 1 AS place, hash, path FROM (SELECT path, sha256('leaf:{{"path":"' || path || '","digest":' || coalesce('"' || digest || '"', 'null') || '}}') AS hash FROM {rows}))"""
    for k in range(1, levels + 1):
        out += f",\nf{k} AS (SELECT place // 16 AS place, string_agg(hash, ',' ORDER BY place) AS family FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY 1)"
        out += f",\nl{k} AS (SELECT place, sha256('node:' || family) AS hash FROM f{k} UNION ALL SELECT place, hash FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) = 1)"
    return out
