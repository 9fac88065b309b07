"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_formatting import format_turns
from .decontamination import contamination
from .exact_dedup import exact_classes
from .html_extraction import extract_text
from .lm_scoring import lm_scores
from .mixing import mix
from .near_dedup import near_classes
from .prefix_trie import prefix_trie
from .secret_scan import ACCESS, ASSIGN, ASSIGN_LEAST, BARE, HEX, LEAST_DIFFERENT, WIDE, secret_scan
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import graded_labels, toxicity
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, _table(spark, sf_dir, "documents"), graded_labels(_table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(spark, _table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark, _table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = format_turns(spark, _table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "call_id", "turn", "level", "place", "status", F.array_join("problems", ";").alias("problems"), "line")


def op4_chat_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn: also messages of other roles, and repeated calls and results."""
    linked = format_turns(spark, _table(spark, sf_dir, "conversations"), whole=True)
    return linked.select("conv_id", "call_id", "turn", "level", "place", "status", F.array_join("problems", ";").alias("problems"), "line", "copies")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, _table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(spark, _table(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, _table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, _table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, _table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, _table(spark, sf_dir, "conversations"))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, _table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, _table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_formatting": op4_chat_formatting,
    "op4_chat_whole": op4_chat_whole,
    "op5_mixing": op5_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_secret_scans": op12_secret_scans,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: Words of the two contracts, and texts with A-Z in lower case only, as DuckDB writes them.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LETTERS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_EXACT = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

_CHAT = """
WITH u AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY 1, 2),
runs AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM u),
c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level FROM runs),
r AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1) AS asked, coalesce(c.turn, r.turn) AS turn,
         c.conv_id IS NOT NULL AS is_call, r.conv_id IS NOT NULL AS answered, c.text AS text, r.text AS answer, c.level::INTEGER AS level
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1)
SELECT conv_id, conv_id || ':' || asked AS call_id, turn, level,
       CASE WHEN is_call THEN row_number() OVER (PARTITION BY conv_id, is_call ORDER BY level, turn) - 1 END AS place,
       CASE WHEN NOT is_call THEN 'orphan' WHEN coalesce(text, '') = '' THEN 'invalid' WHEN answered THEN 'ok' ELSE 'unanswered' END AS status,
       CASE WHEN NOT is_call THEN '' WHEN text IS NULL THEN '$.text: type' WHEN text = '' THEN '$.text: minLength' ELSE '' END AS problems,
       '{"arguments":' || CASE WHEN is_call THEN '{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}' ELSE 'null' END
         || ',"id":"' || conv_id || ':' || asked || '","name":' || CASE WHEN is_call THEN '"respond"' ELSE 'null' END
         || ',"result":' || coalesce(to_json(answer)::VARCHAR, 'null') || '}' AS line
FROM linked
"""

#: Beside the rows of _CHAT, those that it leaves over.
_CHAT_WHOLE = f"""
SELECT *, 1::BIGINT AS copies FROM ({_CHAT})
UNION ALL
SELECT conv_id, NULL, turn, NULL, NULL, 'message', '', '{{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}}', 1
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
UNION ALL
SELECT conv_id, call_id, turn, NULL, NULL, 'duplicate', CASE WHEN is_call AND text IS NULL THEN '$.text: type' WHEN is_call AND text = '' THEN '$.text: minLength' ELSE '' END,
       '{{"arguments":' || CASE WHEN is_call THEN '{{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}}' ELSE 'null' END
         || ',"id":"' || call_id || '","name":' || CASE WHEN is_call THEN '"respond"' ELSE 'null' END
         || ',"result":' || CASE WHEN is_call THEN 'null' ELSE coalesce(to_json(text)::VARCHAR, 'null') END || '}}', copies
FROM (SELECT conv_id, conv_id || ':' || CASE WHEN role = 'user' THEN turn ELSE turn - 1 END AS call_id, turn, role = 'user' AS is_call, text,
             count(*) - CASE WHEN text IS NOT DISTINCT FROM min(text) OVER (PARTITION BY conv_id, turn, role) THEN 1 ELSE 0 END AS copies
      FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, turn, role, text) WHERE copies > 0
"""

_LM = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, {_SPACED.format("coalesce(text, '')")} AS words FROM documents),
w AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
g AS (SELECT row, word, lag(word) OVER (PARTITION BY row ORDER BY i) AS before FROM w),
n AS (SELECT greatest(count(*) - 1, 1) AS others FROM w),
one AS (SELECT word, count(*) - 1 AS n1 FROM w GROUP BY 1),
two AS (SELECT before, word, count(*) - 1 AS n2 FROM g WHERE before IS NOT NULL GROUP BY 1, 2),
s AS (SELECT g.row, one.n1, CASE
        WHEN g.before IS NOT NULL AND two.n2 > 0 THEN ln(two.n2 / b.n1)
        ELSE ln(greatest(one.n1, 1) / n.others) + CASE WHEN g.before IS NULL THEN 0 ELSE ln(0.4) END END AS score
      FROM g JOIN one ON one.word = g.word LEFT JOIN two ON two.before = g.before AND two.word = g.word LEFT JOIN one b ON b.word = g.before, n),
t AS (SELECT row, sum(score) AS score, count(*) FILTER (WHERE n1 = 0) AS n_unseen FROM s GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_unseen, 0) AS n_unseen, round(score, 4) AS log_score, round(score / len(words), 6) AS mean_log_score
FROM d LEFT JOIN t USING (row)
"""

_SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SPACED.format("coalesce(text, '')")} AS words FROM documents),
s AS (SELECT row, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13),
h AS (SELECT row, doc_id, i, sha256(list_aggregate(words[i:i + 12], 'string_agg', ' ')) AS h FROM s),
late AS (SELECT row, i FROM (SELECT row, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS least FROM h) WHERE doc_id > least),
gone AS (SELECT DISTINCT row, i + k AS i FROM late, unnest(range(0, 13)) AS u(k)),
per AS (SELECT row, count(*) AS n_removed, list(i) AS gone FROM gone GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(list_aggregate(list_filter(list_transform(range(1, len(words) + 1), lambda k: CASE WHEN gone IS NULL OR NOT list_contains(gone, k) THEN words[k] END), lambda x: x IS NOT NULL), 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN per USING (row)
"""

_CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_LETTERS.format(_LOWER)} AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_LETTERS.format(_LOWER)} AS words FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(words)) AS n, list_aggregate(words[i:i + least(13, len(words)) - 1], 'string_agg', ' ') AS win
      FROM (SELECT item, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
w AS (SELECT row, i, n, list_aggregate(words[i:i + n - 1], 'string_agg', ' ') AS win
      FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT row, i, w.n, item FROM w JOIN p ON p.win = w.win AND p.n = w.n),
places AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, 13)) AS u(k) WHERE k < n GROUP BY 1),
items AS (SELECT row, count(DISTINCT item) AS n_items, list_aggregate(list_sort(list_distinct(list(item))), 'string_agg', ',') AS names FROM hits GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN places USING (row) LEFT JOIN items USING (row)
"""

_SHINGLES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS words FROM documents),
t AS (SELECT DISTINCT doc_id, md5_number_lower(list_aggregate(words[i:i + least(5, len(words)) - 1], 'string_agg', ' ')) AS t
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS i FROM d WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

#: CRC-32 of the bytes of a decimal number, bit by bit with the reflected polynomial.
_CRC = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda k: ascii(substr({0}::VARCHAR, k, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_resize([0::BIGINT], 8, 0::BIGINT)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"
_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS place FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM s)),
r AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN s ON s.conv_id = c.base AND place < h
      UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN s USING (conv_id) WHERE place >= h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, md5(length(role) || ':' || role || text) AS turn, strlen(text) AS bytes FROM r),
u AS (SELECT conv_id, depth, bytes, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM n
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
last AS (SELECT conv_id, max(depth) AS depth FROM u GROUP BY 1),
nodes AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM u GROUP BY 1, 2),
ends AS (SELECT depth, node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM u JOIN last USING (conv_id, depth) GROUP BY 1, 2),
up AS (SELECT a.depth, a.node, b.node AS above, p.conv_id AS parent FROM nodes a JOIN u b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1 JOIN nodes p ON p.depth = b.depth AND p.node = b.node),
kids AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM up GROUP BY 1, 2),
sums AS (SELECT b.depth, b.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * a.bytes)::BIGINT AS saved
         FROM nodes a LEFT JOIN kids USING (depth, node) JOIN u b ON b.conv_id = a.conv_id AND b.depth <= a.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (depth, node) LEFT JOIN up USING (depth, node) LEFT JOIN kids USING (depth, node) LEFT JOIN ends USING (depth, node)
"""

_quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
k AS (SELECT * FROM (VALUES (0, 'assign', {_quoted(ASSIGN)}, 2, {ASSIGN_LEAST}), (1, 'access', {_quoted(ACCESS)}, 0, 1), (2, 'hex', {_quoted(HEX)}, 0, 1), (3, 'owned', {_quoted(BARE)}, 0, 1)) AS k(kind, name, pattern, part, least)),
f AS (SELECT row, kind, name, part, least, pattern, source, lang,
             CASE kind WHEN 0 THEN regexp_extract_all(text, {_quoted(ASSIGN)}) WHEN 1 THEN regexp_extract_all(text, {_quoted(ACCESS)}) WHEN 2 THEN regexp_extract_all(text, {_quoted(HEX)}) ELSE regexp_extract_all(text, {_quoted(BARE)}) END AS found,
             CASE kind WHEN 0 THEN string_split_regex(text, {_quoted(ASSIGN)}) WHEN 1 THEN string_split_regex(text, {_quoted(ACCESS)}) WHEN 2 THEN string_split_regex(text, {_quoted(HEX)}) ELSE string_split_regex(text, {_quoted(BARE)}) END AS parts
      FROM d, k),
m AS (SELECT row, kind, name, least, source, lang, unnest(found) AS m, unnest(parts[1:len(found)]) AS p, unnest(range(len(found))) AS i FROM f WHERE len(found) > 0),
v AS (SELECT *, (sum(length(p) + length(m)) OVER (PARTITION BY row, kind ORDER BY i) - length(m))::BIGINT AS start, CASE kind WHEN 0 THEN regexp_extract(m, {_quoted(ASSIGN)}, 2) ELSE m END AS value FROM m),
c AS (SELECT row, kind, name, source, lang, start, start + length(m) AS stop, value FROM v
      WHERE length(value) >= least AND (kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {LEAST_DIFFERENT}))),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners FROM c GROUP BY 1),
s AS (SELECT c.*, owners FROM c JOIN o USING (value)
      WHERE kind < 3 OR (owners = 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.row = c.row AND b.kind < 3 AND b.start < c.stop AND c.start < b.stop))),
r AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
             count(*) FILTER (WHERE owners = 1) AS n_owned, count(*) FILTER (WHERE owners >= {WIDE}) AS n_example FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN r USING (row)
"""

#: op1 and op3 train models, op5 leaves the order of blocks open, op8 has too many windows and op13 needs eigenvectors:
#: tests/llm hold these to brute force, and op1 and op3 to held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": _EXACT,
    "op4_chat_formatting": _CHAT,
    "op4_chat_whole": _CHAT_WHOLE,
    "op6_lm_scoring": _LM,
    "op7_jaccard_join": _SHINGLES,
    "op9_decontamination": _CONTAMINATION,
    "op10_substring_dedup": _SUBSTRING,
    "op11_prefix_trie": _TRIE,
    "op12_secret_scans": _SECRETS,
}
