"""Every query of the panel over the provided tables, with the SQL that an independent engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import additive, auroc, bootstrap, cluster, detector, gates, manifests, page, qap, quantiles, ranking, spearman, text_similarity, views
from ..session import cut
from .tables import AUROC_SQL, BLOCKS_SQL, CELLS, EXCHANGES_SQL, HUMAN_CELL, MANIFEST_SQL, PAIRS_SQL, SCORES_SQL, SPLIT_SQL, WHITESPACE_SQL, blocks, exchanges, manifest, merkle_sql, normal_sql, pairs, scores, table, words_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
# fixed values: parameters of the panel
ALPHA = 0.05
SEED = 730241
CLUSTER_SEED = 20260928
REPLICATES = 10_000
CONTRASTS = {"click-error": ("click", "error"), "purchase-click": ("purchase", "click"), "signup-purchase": ("signup", "purchase"), "signup-error": ("signup", "error")}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- text, identities, manifests ---------------------------------------------------------------------------------


@query(f"WITH {MANIFEST_SQL} SELECT compact_index, source_id, human_sha256, human_word_count::BIGINT AS human_word_count, ceil(human_word_count * 0.9::DOUBLE)::BIGINT AS low_words, floor(human_word_count * 1.1::DOUBLE)::BIGINT AS high_words, split_origin FROM manifest")
def source_manifest(spark, sf_dir):
    return manifest(spark, sf_dir).select("compact_index", "source_id", "human_sha256", *_long("human_word_count", "low_words", "high_words"), "split_origin")


@query(f"SELECT doc_id, sha256({normal_sql('text')}) AS normal_sha256, length({normal_sql('text')})::BIGINT AS n FROM documents")
def normalize_text(spark, sf_dir):
    normal = text.normalize_whitespace("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256_text(normal).alias("normal_sha256"), F.length(normal).cast("long").alias("n"))


@query(f"SELECT doc_id, ({words_sql('text')})::BIGINT AS words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), text.word_count("text")).cast("long").alias("words"))


@query("SELECT doc_id, sha256(text) AS human_sha256, (('0x' || substr(sha256('730241|' || doc_id || '|' || source), 1, 16))::UBIGINT % 2147483647)::BIGINT AS seed FROM documents")
def stable_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256_text("text").alias("human_sha256"), text.stable_seed("doc_id", "source", base_seed=SEED).alias("seed"))


@query("SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS blob_sha1 FROM documents")
def git_blob_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.git_blob_sha1(F.encode("text", "utf-8")).alias("blob_sha1"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS compact_index FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
def label_filter_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id")
    return manifests.indexed(rows, "doc_id").select("doc_id", "compact_index")


@query(f"WITH {MANIFEST_SQL} SELECT source_id, compact_index, 'main' AS cohort FROM manifest WHERE compact_index BETWEEN 0 AND 499")
def cohort_main(spark, sf_dir):
    return manifests.main_cohort(manifest(spark, sf_dir)).select("source_id", "compact_index", "cohort")


@query(f"WITH {MANIFEST_SQL} SELECT source_id, compact_index, 'pilot' AS cohort FROM manifest WHERE compact_index >= 500 AND split_origin = 'train' AND compact_index NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ORDER BY compact_index LIMIT 50")
def cohort_pilot(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0").select(text.source_id("doc_id").alias("source_id"))
    return manifests.pilot_cohort(manifest(spark, sf_dir), bad).select("source_id", "compact_index", "cohort")


@query(f"WITH {MANIFEST_SQL} SELECT source_id, m.human_sha256, sha256('Topic: ' || topic || chr(10) || 'Text: ' || text) AS prompt_sha256 FROM manifest m JOIN labels ON doc_id = compact_index WHERE quality = 1")
def queue_enrich_join(spark, sf_dir):
    humans = manifest(spark, sf_dir)
    queued = humans.drop("text").join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("compact_index")), "compact_index")
    rows = manifests.with_source_text(queued, humans)
    return manifests.prompts(rows, "Topic: {topic}\nText: {source}", F.lit(""), source=F.col("source_text")).select("source_id", "human_sha256", "prompt_sha256")


@query("SELECT source, sha256(string_agg('EXAMPLE ' || n || ': ' || lang, chr(10) || chr(10) ORDER BY n)) AS bundle_sha256 FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5 GROUP BY 1")
def exemplar_bundle(spark, sf_dir):
    rows = manifests.numbered_in_group(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"], "n").where("n <= 5")
    example = F.format_string("EXAMPLE %d: %s", "n", "lang")
    return rows.groupBy("source").agg(text.sha256_text(text.numbered_bundle(F.col("n"), example)).alias("bundle_sha256"))


# --- gates -------------------------------------------------------------------------------------------------------


@query("SELECT 'fields' AS gate, 'fields' AS rule, a.doc_id::VARCHAR AS key, concat_ws(',', CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END) AS detail FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.lang IS DISTINCT FROM b.lang OR a.source IS DISTINCT FROM b.source OR a.n_chars IS DISTINCT FROM b.n_chars UNION ALL SELECT 'fields', 'partner', doc_id::VARCHAR, '' FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def field_mismatch_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return gates.equal_fields(rows, rows.withColumn("doc_id", F.col("doc_id") - 1), "fields", ["doc_id"], ["lang", "source", "n_chars"])


@query("SELECT 'texts' AS gate, 'unique' AS rule, sha256(text) AS key, count(*)::VARCHAR AS detail FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_key_gate(spark, sf_dir):
    return gates.unique(table(spark, sf_dir, "documents").select(text.sha256_text("text").alias("human_sha256")), "texts", ["human_sha256"])


@query("SELECT 'labels' AS gate, 'missing' AS rule, doc_id::VARCHAR AS key, '' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'labels', 'unexpected', doc_id::VARCHAR, '' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def coverage_gate(spark, sf_dir):
    return gates.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "labels", ["doc_id"])


@query("SELECT DISTINCT 'cohorts' AS gate, 'disjoint' AS rule, sha256(a.text) AS key, '' AS detail FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def disjoint_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(text.sha256_text("text").alias("human_sha256"), (F.col("doc_id") % 2).alias("side")).where("human_sha256 IS NOT NULL")
    return gates.disjoint(rows.where("side = 0"), rows.where("side = 1"), "cohorts", ["human_sha256"])


@query(f"WITH {EXCHANGES_SQL} SELECT 'leak' AS gate, 'leak' AS rule, conv_id || '|' || turn AS key, '' AS detail FROM exchanges WHERE length(source_text) > 0 AND contains(CASE WHEN conv_id % 7 = 0 THEN rewritten || source_text ELSE rewritten END, source_text)")
def leak_gate(spark, sf_dir):
    """The source's text is put into the answers of every seventh conversation, so that there are leaks to find."""
    rows = exchanges(spark, sf_dir).withColumn("prompt", F.when(F.col("conv_id") % 7 == 0, F.concat("rewritten", "source_text")).otherwise(F.col("rewritten")))
    return gates.leaks(rows.select("conv_id", "turn", "prompt"), rows.select("conv_id", "turn", "source_text"), "leak", ["conv_id", "turn"], "prompt", "source_text")


#: Main rows with faults put in, so that each rule has rows to find: (column, divisor of compact_index, Spark, SQL).
_QUEUE_FAULTS = [
    ("split_origin", 11, "'dev'"),
    ("topic_sha256", 13, "'0'"),
    ("high_words", 17, "low_words - 1"),
    ("target_words", 19, "NULL"),
    ("source_id", 23, "concat('x', source_id)"),
]
_QUEUE_COLUMNS = ["source_id", "compact_index", "split_origin", "cohort", "human_sha256", "topic", "topic_sha256", "target_words", "low_words", "high_words"]
_QUEUE_SQL = f"""WITH {MANIFEST_SQL},
m AS (SELECT source_id, compact_index, split_origin, 'main' AS cohort, human_sha256, topic, topic_sha256, human_word_count AS target_words,
             ceil(human_word_count * 0.9::DOUBLE)::INTEGER AS low_words, floor(human_word_count * 1.1::DOUBLE)::INTEGER AS high_words FROM manifest),
f AS (SELECT {", ".join(next((f"CASE WHEN compact_index % {n} = 0 THEN {v} ELSE {c} END AS {c}" for k, n, v in _QUEUE_FAULTS if k == c), c) for c in _QUEUE_COLUMNS)} FROM m),
q AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE compact_index % 29 = 0),
r AS (SELECT concat_ws('|', coalesce(cohort, 'null'), coalesce(source_id, 'null')) AS key, * FROM q)
SELECT 'queue' AS gate, 'required' AS rule, key, '' AS detail FROM r WHERE {" OR ".join(f"{c} IS NULL" for c in _QUEUE_COLUMNS)}
UNION ALL SELECT 'queue', 'unique', key, count(*)::VARCHAR FROM r GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'queue', 'source id', key, '' FROM r WHERE (source_id = 'arxiv2k:' || CASE WHEN length(compact_index::VARCHAR) < 4 THEN lpad(compact_index::VARCHAR, 4, '0') ELSE compact_index::VARCHAR END) IS NOT TRUE
UNION ALL SELECT 'queue', 'sha256 of topic', key, coalesce(topic_sha256, 'null') FROM r WHERE (sha256(topic) = topic_sha256) IS NOT TRUE
UNION ALL SELECT 'queue', 'bounds', key, '' FROM r WHERE (low_words <= target_words AND target_words <= high_words) IS NOT TRUE
UNION ALL SELECT 'queue', 'split', key, '' FROM r WHERE (split_origin IN ('train', 'val', 'test')) IS NOT TRUE"""


@query(_QUEUE_SQL)
def queue_gate(spark, sf_dir):
    # written once, as row rules and repeated keys are read from it: texts are hashed and counted in one pass
    rows = cut(manifest(spark, sf_dir).withColumns({"cohort": F.lit("main"), "target_words": F.col("human_word_count")}).select(*_QUEUE_COLUMNS))
    rows = rows.select(*(next((F.expr(f"CASE WHEN compact_index % {n} = 0 THEN {v} ELSE {c} END").alias(c) for k, n, v in _QUEUE_FAULTS if k == c), F.col(c)) for c in _QUEUE_COLUMNS))
    return gates.queue(rows.union(rows.where("compact_index % 29 = 0")))


@query(f"WITH r AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents), {merkle_sql('r')} SELECT hash AS lock_sha256 FROM l6")
def canonical_lock_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), text.sha256_text("text").alias("digest"))
    return gates.lock_digest(rows)


@query("SELECT source, count(*) AS n, sha256('[' || string_agg('\"' || doc_id || '\"', ',' ORDER BY doc_id) || ']') AS ids_sha256 FROM documents GROUP BY 1")
def ordered_list_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("id"))
    return manifests.ordered_ids(rows, ["source"], "id", "doc_id").withColumn("n", F.col("n").cast("long"))


@query("SELECT 'panel' AS gate, 'missing' AS rule, 'scale|' || c AS key, '' AS detail FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'refund']) AS c) WHERE c NOT IN (SELECT event_type FROM events) UNION ALL SELECT 'panel', 'unexpected', 'scale|' || event_type, '' FROM (SELECT DISTINCT event_type FROM events) WHERE event_type NOT IN ('click', 'error', 'purchase', 'signup', 'refund')")
def panel_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("scale").alias("suite"), F.col("event_type").alias("cell"), F.col("user_id").cast("string").alias("source_id"))
    cells = spark.createDataFrame([("scale", c) for c in (*CELLS, "refund")], "suite string, cell string")
    return gates.coverage(cells, rows, "panel", ["suite", "cell"])


# --- joins and aggregates ----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))")
def anti_join_near_copies(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return manifests.without_near_copies(docs, docs, labels.where("quality = 0"), ["doc_id"]).select("doc_id")


@query("SELECT a.doc_id, coalesce(b.first, -1) AS original_index FROM documents a LEFT JOIN (SELECT text, min(doc_id) AS first FROM documents WHERE lang = 'en' GROUP BY 1) b ON a.text = b.text")
def first_match_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lookup = docs.where("lang = 'en'").select("text", F.col("doc_id").alias("original_index"))
    return manifests.first_match(docs, lookup, "text", "original_index", "original_index").select("doc_id", "original_index")


@query("SELECT lang, max_by(doc_id, n_chars * 1000000 + doc_id) AS last_doc FROM documents GROUP BY 1")
def last_wins_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("at", F.col("n_chars") * 1000000 + F.col("doc_id")).withColumnRenamed("doc_id", "last_doc")
    return manifests.last_value(rows, ["lang"], "last_doc", "at")


@query(f"SELECT split, count(*) AS n FROM (SELECT {SPLIT_SQL.format('doc_id')} AS split FROM documents) GROUP BY 1")
def split_counts(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy(F.col("split_origin").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 0) AS low, count(DISTINCT doc_id) AS documents, bool_and(toxic IN (0, 1)) AS binary FROM labels")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("low"), F.count_distinct("doc_id").alias("documents"), F.bool_and(F.col("toxic").isin(0, 1)).alias("binary"))


@query(f"SELECT lang, min(w)::BIGINT AS least, median(w)::DOUBLE AS middle, max(w)::BIGINT AS most FROM (SELECT lang, {words_sql('text')} AS w FROM documents) GROUP BY 1")
def word_count_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.when(F.col("text").isNotNull(), text.word_count("text")).cast("long").alias("w"))
    return rows.groupBy("lang").agg(F.min("w").alias("least"), F.median("w").cast("double").alias("middle"), F.max("w").alias("most"))


@query(f"WITH {BLOCKS_SQL} SELECT cell, round(quantile_cont(value, 0.025), 4) AS low, round(quantile_cont(value, 0.975), 4) AS high, round(stddev_pop(value), 4) AS spread FROM blocks GROUP BY 1")
def linear_quantiles(spark, sf_dir):
    rows = cut(blocks(spark, sf_dir))
    found = quantiles.linear_quantiles(rows, ["cell"], "value", {"low": 0.025, "high": 0.975})
    return found.join(rows.groupBy("cell").agg(F.round(F.stddev_pop("value"), 4).alias("spread")), "cell").select("cell", _r("low", 4), _r("high", 4), "spread")


# --- ranks and demeaning -----------------------------------------------------------------------------------------


@query("WITH e AS (SELECT event_id, round(value, 1) AS v FROM events) SELECT event_id, (2 * rank() OVER (ORDER BY v) + count(*) OVER (PARTITION BY v) - 1)::BIGINT AS twice_rank FROM e")
def midrank_global(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.round("value", 1).alias("v"))
    return ranking.midranks(rows, [], "v").select("event_id", "twice_rank")


@query("WITH e AS (SELECT event_id, event_type, round(value, 1) AS v FROM events) SELECT event_id, event_type, (2 * rank() OVER (PARTITION BY event_type ORDER BY v) + count(*) OVER (PARTITION BY event_type, v) - 1)::BIGINT AS twice_rank FROM e")
def midrank_in_cell(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 1).alias("v"))
    return ranking.midranks(rows, ["event_type"], "v").select("event_id", "event_type", "twice_rank")


@query(f"WITH {BLOCKS_SQL} SELECT source, cell, (2 * rank() OVER (PARTITION BY source ORDER BY value) + count(*) OVER (PARTITION BY source, value) - 1)::BIGINT AS twice_rank FROM blocks")
def midrank_in_block(spark, sf_dir):
    return blocks(spark, sf_dir).select("source", "cell", ranking.twice_midrank("value", ["source"]).cast("long").alias("twice_rank"))


@query(f"WITH {BLOCKS_SQL} SELECT source, cell, round(value - avg(value) OVER (PARTITION BY source), 4) AS demeaned FROM blocks")
def group_demean(spark, sf_dir):
    return blocks(spark, sf_dir).select("source", "cell", F.round(ranking.demean("value", ["source"]), 4).alias("demeaned"))


@query(f"WITH {BLOCKS_SQL}, a AS (SELECT source, cell, value - avg(value) OVER (PARTITION BY source) AS v FROM blocks), b AS (SELECT source, cell, v - avg(v) OVER (PARTITION BY cell) AS v FROM a), c AS (SELECT source, cell, v - avg(v) OVER (PARTITION BY source) AS v FROM b), d AS (SELECT source, cell, v - avg(v) OVER (PARTITION BY cell) AS v FROM c) SELECT source, cell, round(v, 3) AS demeaned FROM d")
def two_way_demean(spark, sf_dir):
    rows = ranking.two_way_demean(blocks(spark, sf_dir), "value", "source", "cell", rounds=2)
    return rows.select("source", "cell", F.round("demeaned", 3).alias("demeaned"))


@query("SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) >= 2)")
def singleton_drop(spark, sf_dir):
    return ranking.without_singletons(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text").select("doc_id", "source")


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def factor_codes(spark, sf_dir):
    rows = ranking.factor_codes(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")
    return rows.select("event_id", F.col("code").cast("long").alias("code"))


# --- AUROC -------------------------------------------------------------------------------------------------------


@query(f"WITH {AUROC_SQL} SELECT cell, twice_wins, auroc, ceiling FROM auroc")
def auroc_ranksum(spark, sf_dir):
    return auroc.auroc(scores(spark, sf_dir)).select("cell", "twice_wins", "auroc", "ceiling")


@query(f"WITH {SCORES_SQL}, k AS (SELECT a.cell, a.source, avg(CASE WHEN a.generated > b.human THEN 1.0 WHEN a.generated = b.human THEN 0.5 ELSE 0.0 END) AS x, avg(CASE WHEN b.generated > a.human THEN 1.0 WHEN b.generated = a.human THEN 0.5 ELSE 0.0 END) AS y FROM scores a JOIN scores b ON a.cell = b.cell GROUP BY 1, 2) SELECT cell, source, round((x + y) / 2, 9) AS contribution FROM k")
def sourcewise_contributions(spark, sf_dir):
    return auroc.contributions(scores(spark, sf_dir)).select("cell", "source", _r("contribution", 9))


@query(f"WITH {AUROC_SQL} SELECT cell, CASE WHEN auroc > 0 AND auroc < 1 THEN round(sqrt(2.0e0) * ({numeric.inverse_normal_sql('auroc')}), 9) END AS dprime, CASE WHEN auroc >= 1 THEN 'right' WHEN auroc <= 0 THEN 'left' END AS censoring FROM auroc")
def dprime(spark, sf_dir):
    return auroc.auroc(scores(spark, sf_dir)).select("cell", F.round("dprime.value", 9).alias("dprime"), F.col("dprime.censoring").alias("censoring"))


# --- rank tests --------------------------------------------------------------------------------------------------

_SPEARMAN_SQL = f"""WITH RECURSIVE {BLOCKS_SQL},
c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY cell) AS x, 2 * rank() OVER (PARTITION BY source ORDER BY value) + count(*) OVER (PARTITION BY source, value) - 1 AS r FROM blocks),
s AS (SELECT source, sum(2 * x * r)::BIGINT AS o, list(r ORDER BY x) AS rs, sum(r * r)::BIGINT AS rr FROM c GROUP BY 1 HAVING count(*) = 5),
p(used, step) AS (SELECT []::INTEGER[], 0 UNION ALL SELECT list_append(used, k), step + 1 FROM p, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS k) WHERE step < 5 AND NOT list_contains(used, k)),
f AS (SELECT used FROM p WHERE step = 5),
m AS (SELECT source, o, rr, 2 * (rs[used[1]] + 2 * rs[used[2]] + 3 * rs[used[3]] + 4 * rs[used[4]] + 5 * rs[used[5]]) AS v FROM s, f)
SELECT source, round((o - 180.0) / nullif(sqrt(40.0e0) * sqrt(rr - 180.0e0), 0), 9) AS rho, count(*) FILTER (WHERE v <= o) AS count, count(*) AS total FROM m GROUP BY source, o, rr"""


def _ordered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.array_position(F.array(*map(F.lit, sorted((*CELLS, HUMAN_CELL)))), F.col("cell"))
    return blocks(spark, sf_dir).withColumn("x", number.cast("int")).withColumn("value", F.col("value").cast("double"))


@query(_SPEARMAN_SQL)
def exact_spearman(spark, sf_dir):
    out = spearman.exact_test(_ordered_blocks(spark, sf_dir), "source", "x", "value", 5)
    return out.select("source", _r("rho", 9), "count", "total")


@query()
def ceiling_audits(spark, sf_dir):
    """Each user's cells as a suite, those of the largest total taken as ceilings: hidden orders and their verdicts."""
    rows = _ordered_blocks(spark, sf_dir)
    top = F.max("value").over(Window.partitionBy("source"))
    out = spearman.ceiling_audit(rows.withColumn("top", F.col("value") >= 0.8 * top), "source", "x", "value", "top", 5)
    decided = spearman.verdict(F.col("audit"), F.col("p_high") < ALPHA, F.col("directions") == "decreasing")
    return out.select("source", *_long("ceilings", "orders"), _r("rho_low"), _r("rho_high"), _r("p_low"), _r("p_high"), "directions", "decisions", "audit", decided.alias("verdict"))


@query(f"WITH {BLOCKS_SQL}, r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY cell) AS x, 2 * rank() OVER (PARTITION BY source ORDER BY value) + count(*) OVER (PARTITION BY source, value) - 1 AS r FROM blocks) SELECT count(DISTINCT source) AS blocks, sum(x * r)::BIGINT AS twice_l, count(DISTINCT source) * 45.0::DOUBLE AS null_mean FROM r")
def page_statistic(spark, sf_dir):
    rows = _ordered_blocks(spark, sf_dir).withColumn("suite", F.lit("scale"))
    out = page.statistic(page.patterns(rows, ["suite"], "source", "x", "value"), ["suite"])
    return out.select("blocks", "twice_l", F.col("null_mean").cast("double").alias("null_mean"))


@query()
def page_exact_tail(spark, sf_dir):
    rows = _ordered_blocks(spark, sf_dir).withColumn("suite", F.lit("scale"))
    out = page.exact_test(rows, ["suite"], "source", "x", "value")
    return out.select("suite", "blocks", "twice_l", "direction", "numerator", "denominator", "p")


@query()
def page_ceiling_audit(spark, sf_dir):
    rows = _ordered_blocks(spark, sf_dir).withColumn("suite", F.lit("stage")).withColumn("top", F.col("x") >= 4)
    return page.ceiling_audit(rows, "suite", "source", "x", "value", "top")


# --- bootstrap ---------------------------------------------------------------------------------------------------

_DRAWS_SQL = """places AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS place FROM (SELECT DISTINCT source FROM scores)),
n AS (SELECT count(*) AS n FROM places),
draws AS (SELECT rep, (('0x' || substr(md5({seed} || '|' || rep || '|' || k), 1, 15))::BIGINT % n) AS place FROM (SELECT unnest(range({reps})) AS rep), n, unnest(range(n)) AS u(k)),
w AS (SELECT rep, place, count(*) AS w FROM draws GROUP BY 1, 2),
sides AS (SELECT rep, cell, human AS score, w AS h, 0 AS g FROM w JOIN places USING (place) JOIN scores USING (source) UNION ALL SELECT rep, cell, generated, 0, w FROM w JOIN places USING (place) JOIN scores USING (source)),
hist AS (SELECT rep, cell, score, sum(h) AS h, sum(g) AS g FROM sides GROUP BY 1, 2, 3),
cum AS (SELECT rep, cell, h, g, coalesce(sum(h) OVER (PARTITION BY rep, cell ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist),
samples AS (SELECT rep, cell, sum(g * (2 * below + h))::DOUBLE / (2.0::DOUBLE * sum(h) * sum(g)) AS auroc FROM cum GROUP BY 1, 2)""".format(seed=SEED, reps=REPLICATES)


@query(f"WITH {SCORES_SQL}, {_DRAWS_SQL} SELECT cell, round(quantile_cont(auroc, 0.025), 9) AS ci_low, round(quantile_cont(auroc, 0.975), 9) AS ci_high FROM samples GROUP BY 1")
def paired_bootstrap_ci(spark, sf_dir):
    out = bootstrap.cell_intervals(bootstrap.samples(scores(spark, sf_dir), REPLICATES, SEED))
    return out.select("cell", _r("ci_low", 9), _r("ci_high", 9))


@query(
    f"WITH {AUROC_SQL}, {_DRAWS_SQL}, pairs AS (SELECT * FROM (VALUES {', '.join(repr((k, *v)) for k, v in CONTRASTS.items())}) AS t(contrast, a, b)),"
    " d AS (SELECT contrast, x.auroc - y.auroc AS d FROM pairs JOIN samples x ON x.cell = a JOIN samples y ON y.cell = b AND y.rep = x.rep)"
    " SELECT contrast, round(x.auroc - y.auroc, 9) AS estimate, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high FROM pairs JOIN auroc x ON x.cell = a JOIN auroc y ON y.cell = b JOIN (SELECT contrast, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY 1) USING (contrast)"
)
def bootstrap_contrasts(spark, sf_dir):
    rows = cut(scores(spark, sf_dir))
    out = bootstrap.contrasts(bootstrap.samples(rows, REPLICATES, SEED), auroc.auroc(rows), CONTRASTS)
    return out.select("contrast", _r("estimate", 9), _r("ci_low", 9), _r("ci_high", 9))


@query(
    f"WITH {AUROC_SQL}, {_DRAWS_SQL}, d AS (SELECT (max(auroc) FILTER (WHERE cell = 'signup') - max(auroc) FILTER (WHERE cell = 'click')) - (max(auroc) FILTER (WHERE cell = 'purchase') - max(auroc) FILTER (WHERE cell = 'error')) AS d FROM samples GROUP BY rep),"
    " e AS (SELECT (max(auroc) FILTER (WHERE cell = 'signup') - max(auroc) FILTER (WHERE cell = 'click')) - (max(auroc) FILTER (WHERE cell = 'purchase') - max(auroc) FILTER (WHERE cell = 'error')) AS e, bool_or(ceiling) AS top FROM auroc),"
    " i AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d)"
    " SELECT round(e, 9) AS estimate, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, CASE WHEN top THEN 'CEILING_CENSORED' WHEN lo > 0 THEN 'DISSOCIATION_RW_MORE_DETECTABLE' WHEN hi < 0 THEN 'DISSOCIATION_RW_LESS_DETECTABLE' ELSE 'NO_DISSOCIATION' END AS decision FROM e, i"
)
def dissociation_did(spark, sf_dir):
    """Difference in differences of two stages under two conditions, with its decision label."""
    rows = cut(scores(spark, sf_dir))
    gap = lambda df, by: df.groupBy(*by).pivot("cell", list(CELLS)).agg(F.first("auroc")).withColumn("d", (F.col("signup") - F.col("click")) - (F.col("purchase") - F.col("error")))
    low, high = bootstrap.interval("d")
    spread = gap(bootstrap.samples(rows, REPLICATES, SEED), ["rep"]).agg(low.alias("ci_low"), high.alias("ci_high"))
    point = auroc.auroc(rows).withColumn("one", F.lit(1))
    tops = point.groupBy("one").agg(F.max(F.when(F.col("cell") == "signup", F.col("ceiling"))).alias("t1"), F.max(F.when(F.col("cell") == "click", F.col("ceiling"))).alias("t2"), F.max(F.when(F.col("cell") == "purchase", F.col("ceiling"))).alias("t3"), F.max(F.when(F.col("cell") == "error", F.col("ceiling"))).alias("t4"))
    met = gap(point, ["one"]).join(tops, "one").crossJoin(spread)
    label = bootstrap.decision(F.col("d"), F.col("ci_low"), F.col("ci_high"), [F.col(f"t{k}") for k in (1, 2, 3, 4)])
    return met.select(F.round("d", 9).alias("estimate"), _r("ci_low", 9), _r("ci_high", 9), label.alias("decision"))


# --- pair matrices -----------------------------------------------------------------------------------------------

_MEANS_SQL = "parts AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), means AS (SELECT label, dim, avg(v::DOUBLE) AS v FROM parts GROUP BY 1, 2)"
_MATRIX_SQL = f"""{_MEANS_SQL},
m AS (SELECT a.label AS i, b.label AS j, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS value FROM means a JOIN means b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2),
norms AS (SELECT label, sqrt(sum(v * v)) AS norm FROM means GROUP BY 1)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qap.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(f"WITH {_MATRIX_SQL} SELECT i, j, round(value, 9) AS value FROM m")
def pair_matrix(spark, sf_dir):
    return qap.pair_matrix(_means(spark, sf_dir)).select("i", "j", _r("value", 9))


@query(f"WITH {_MATRIX_SQL}, t AS (SELECT i, j, value * norm AS v FROM m JOIN norms ON label = j) SELECT a.i, a.j, round((a.v + b.v) / 2, 9) AS value FROM t a JOIN t b ON a.i = b.j AND a.j = b.i")
def symmetrise_norm_corrected(spark, sf_dir):
    means = _means(spark, sf_dir)
    norms = means.select("label", numeric.norm(F.col("mean")).alias("norm"))
    return qap.symmetrise(qap.norm_corrected(qap.pair_matrix(means), norms)).select("i", "j", _r("value", 9))


def _qap_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Cosines of label means in either half of the components; i and j number all labels from 0. And how many there are."""
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    labels = rows.select("label").distinct().withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)
    labels = cut(labels)
    rows = rows.join(F.broadcast(labels), "label").drop("label").withColumnRenamed("code", "label")
    halves = [qap.pair_matrix(qap.centroids(rows.withColumn("half", F.slice("embedding", a, 32)), "label", "half")) for a in (1, 33)]
    return cut(halves[0].select("i", "j", F.round("value", 9).alias("predictor")).join(halves[1].select("i", "j", F.round("value", 9).alias("target")), ["i", "j"])), labels.count()


def _qap_columns():
    return [_r("rho", 9), "count", "count_abs", "total", *(_r(c) for c in ("null_mean", "null_sd", "null_q95", "null_q99")), "p", "p_abs"]


@query()
def qap_exact(spark, sf_dir):
    return qap.qap_exact(*_qap_input(spark, sf_dir)).select(*_qap_columns())


@query()
def qap_monte_carlo(spark, sf_dir):
    return qap.qap_monte_carlo(*_qap_input(spark, sf_dir), 100_000, CLUSTER_SEED).select(*_qap_columns())


@query()
def qap_delete_one(spark, sf_dir):
    """The exact test of every matrix of all labels but one, from one enumeration."""
    return qap.delete_one(*_qap_input(spark, sf_dir)).select("dropped", *_qap_columns())


@query()
def qap_variants(spark, sf_dir):
    """The exact test over the upper, the lower and both triangles; of a symmetric matrix they have one rho and one p."""
    matrix, n = _qap_input(spark, sf_dir)
    kinds = [qap.qap_exact(matrix, n, which).select(F.lit(which).alias("pairs"), *_qap_columns()) for which in ("upper", "lower", "ordered")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


# --- shifts and detectors ----------------------------------------------------------------------------------------

_SHIFT_SQL = """parts AS (SELECT vec_id, 'm' || (label // 2) AS model, 'c' || (label % 2) AS condition, vec_id % 2 AS made, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
shifts AS (SELECT model, condition, dim, avg(v) FILTER (WHERE made = 1) - avg(v) FILTER (WHERE made = 0) AS v FROM parts GROUP BY 1, 2, 3)"""
_LEFT_OUT_SQL = f"""{_SHIFT_SQL}, sums AS (SELECT condition, dim, sum(v) AS s, count(*) AS n FROM shifts GROUP BY 1, 2),
p AS (SELECT a.model, a.condition, a.dim, a.v, b.v AS model_only, (x.s - a.v) / (x.n - 1) AS task_only, b.v + (x.s - a.v) / (x.n - 1) - (y.s - b.v) / (y.n - 1) AS additive
      FROM shifts a JOIN shifts b ON a.model = b.model AND a.dim = b.dim AND a.condition <> b.condition JOIN sums x ON x.condition = a.condition AND x.dim = a.dim JOIN sums y ON y.condition = b.condition AND y.dim = b.dim)"""


def _shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as five models under two conditions, vectors of odd vec_id as the generated class."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.floor(F.col("label") / 2).cast("string")).alias("model"), F.concat(F.lit("c"), (F.col("label") % 2).cast("string")).alias("condition"), "vec_id", F.posexplode("embedding").alias("dim", "v"))
    return additive.class_shift(rows.withColumn("v", F.col("v").cast("double")), ["model", "condition"], "vec_id % 2 = 1")


@query(f"WITH {_SHIFT_SQL} SELECT model, condition, dim, round(v, 9) AS v FROM shifts")
def class_delta(spark, sf_dir):
    return _shifts(spark, sf_dir).select("model", "condition", F.col("dim").cast("long").alias("dim"), _r("v", 9))


@query(f"WITH {_SHIFT_SQL}, f AS (SELECT *, avg(v) OVER (PARTITION BY model, dim) + avg(v) OVER (PARTITION BY condition, dim) - avg(v) OVER (PARTITION BY dim) AS fit, avg(v) OVER (PARTITION BY dim) AS g FROM shifts) SELECT round(1 - sum((v - fit) ** 2) / sum((v - g) ** 2), 9) AS r2 FROM f")
def additive_fit(spark, sf_dir):
    return additive.r_squared(additive.fitted(_shifts(spark, sf_dir)), "fit").select(_r("r2", 9))


@query(f"WITH {_LEFT_OUT_SQL} SELECT model, condition, round(sqrt(sum(v * v)), 9) AS norm, round(sqrt(sum(additive * additive)), 9) AS predicted_norm, round(sum(v * additive) / (sqrt(sum(v * v)) * sqrt(sum(additive * additive))), 9) AS cosine FROM p GROUP BY 1, 2")
def loo_additive(spark, sf_dir):
    out = additive.cells(additive.left_out(_shifts(spark, sf_dir)), "additive")
    return out.select("model", "condition", _r("norm", 9), _r("predicted_norm", 9), _r("cosine", 9))


@query(f"WITH {_LEFT_OUT_SQL}, g AS (SELECT *, avg(v) OVER (PARTITION BY dim) AS g FROM p) SELECT predictor, round(1 - sum((v - w) ** 2) / sum((v - g) ** 2), 9) AS r2 FROM (SELECT 'additive' AS predictor, v, g, additive AS w FROM g UNION ALL SELECT 'model_only', v, g, model_only FROM g UNION ALL SELECT 'task_only', v, g, task_only FROM g) GROUP BY 1")
def loo_baselines(spark, sf_dir):
    left = cut(additive.left_out(_shifts(spark, sf_dir)))
    rows = [additive.r_squared(left, p).select(F.lit(p).alias("predictor"), _r("r2", 9)) for p in ("additive", "model_only", "task_only")]
    return gates.gather(*rows)


@query(f"WITH {_LEFT_OUT_SQL}, c AS (SELECT sqrt(sum(v * v)) AS x, sqrt(sum(additive * additive)) AS y, sum(v * additive) / (sqrt(sum(v * v)) * sqrt(sum(additive * additive))) AS c FROM p GROUP BY model, condition), m AS (SELECT avg(x) AS m FROM c) SELECT round(1 - sum((x - y) ** 2) / sum((x - m) ** 2), 6) AS norm_r2, round(corr(x, y), 6) AS norm_r, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine FROM c, m")
def loo_summary(spark, sf_dir):
    out = additive.summarise(additive.cells(additive.left_out(_shifts(spark, sf_dir)), "additive"))
    return out.select(_r("norm_r2"), _r("norm_r"), _r("mean_cosine"), _r("min_cosine"))


@query("WITH parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT dim, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM parts WHERE vec_id % 10 < 7 GROUP BY 1) SELECT vec_id, round(sum(((v - m) / s) ** 2), 6) AS squares FROM parts JOIN s USING (dim) GROUP BY 1")
def standardize_train_only(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    return additive.standardise(parts, "vec_id % 10 < 7").groupBy("vec_id").agg(F.round(F.sum(F.col("v") * F.col("v")), 6).alias("squares"))


_CELL_DETECTOR_SQL = """parts AS (SELECT vec_id, label, label // 2 AS cell, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
s AS (SELECT cell, dim, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM parts WHERE vec_id % 10 < 7 GROUP BY 1, 2),
z AS (SELECT vec_id, label, cell, dim, (v - m) / s AS v FROM parts JOIN s USING (cell, dim)),
w AS (SELECT cell, dim, avg(v) FILTER (WHERE label % 2 = 1) - avg(v) FILTER (WHERE label % 2 <> 1) AS w FROM z WHERE vec_id % 10 < 7 GROUP BY 1, 2)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 0 and 1, 2 and 3, ... as cells of two classes."""
    return table(spark, sf_dir, "embeddings").withColumn("cell", F.floor(F.col("label") / 2).cast("long"))


@query(f"WITH {_CELL_DETECTOR_SQL} SELECT vec_id, label, cell, round(sum(v * w), 6) AS score FROM z JOIN w USING (cell, dim) GROUP BY 1, 2, 3")
def detector_scores_cells(spark, sf_dir):
    out = detector.shift_scores(_cells(spark, sf_dir), ["vec_id", "label", "cell"], "embedding", "vec_id % 10 < 7", "label % 2 = 1", ["cell"])
    return out.select("vec_id", "label", "cell", _r("score"))


@query(f"WITH {_CELL_DETECTOR_SQL} SELECT vec_id, label, round(sum(v * w), 6) AS score FROM z JOIN w USING (cell, dim) GROUP BY 1, 2, cell")
def detector_scores(spark, sf_dir):
    return detector_scores_cells(spark, sf_dir).drop("cell")


@query()
def logistic_detector_grid(spark, sf_dir):
    """A detector for each cell, and the scores of all its rows; null where a cell lacks a class to fit or select by."""
    rows = _cells(spark, sf_dir).withColumn("class", F.col("label") % 2).drop("label")
    rows = rows.withColumn("split", F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "val").otherwise("test"))
    scaled = cut(detector.scaled_vectors(rows, ["vec_id", "cell", "class", "split"], "embedding", "split = 'train'", ["cell"]))
    scored, _ = detector.logistic_grids(scaled, "cell", "embedding", "class = 1", "split")
    return scored.select("vec_id", (2 * F.col("cell") + F.col("class")).alias("label"), "cell", "split", "selected_c", F.round("score", 3).alias("score"))


# --- pairs of texts ----------------------------------------------------------------------------------------------


_FOLDED = "regexp_replace({}, '[^\\x00-\\x7F]', '?', 'g')"


@query(f"WITH {EXCHANGES_SQL}, f AS (SELECT conv_id, turn, {_FOLDED.format('source_text')} AS a, {_FOLDED.format('rewritten')} AS b FROM exchanges) SELECT conv_id, turn, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS similarity FROM f")
def edit_similarity(spark, sf_dir):
    """Whole texts, non-ASCII characters folded to one mark, as the other engine counts bytes."""
    folded = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return exchanges(spark, sf_dir).select("conv_id", "turn", F.round(text.edit_similarity(folded("source_text"), folded("rewritten")), 9).alias("similarity"))


@query()
def edit_similarity_whole(spark, sf_dir):
    """Whole texts, character by character; DuckDB's levenshtein counts bytes, so there is no SQL."""
    return exchanges(spark, sf_dir).select("conv_id", "turn", F.round(text.edit_similarity("source_text", "rewritten"), 9).alias("similarity"))


_TOKENS = "CASE WHEN {0} = '' THEN []::VARCHAR[] ELSE string_split({0}, ' ') END"


@query(
    f"WITH {EXCHANGES_SQL}, t AS (SELECT conv_id, turn, {_TOKENS.format(normal_sql('rewritten'))} AS h, {_TOKENS.format(normal_sql('source_text'))} AS r FROM exchanges),"
    " u AS (SELECT conv_id, turn, 1 AS own, h AS w FROM t UNION ALL SELECT conv_id, turn, 0, r FROM t), g AS (SELECT conv_id, turn, own, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM u, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),"
    " c AS (SELECT conv_id, turn, n, g, least(sum(own), sum(1 - own)) AS m FROM g GROUP BY 1, 2, 3, 4), m AS (SELECT conv_id, turn, coalesce(sum(m) FILTER (WHERE n = 1), 0) AS m1, coalesce(sum(m) FILTER (WHERE n = 2), 0) AS m2, coalesce(sum(m) FILTER (WHERE n = 3), 0) AS m3, coalesce(sum(m) FILTER (WHERE n = 4), 0) AS m4 FROM c GROUP BY 1, 2)"
    " SELECT conv_id, turn, round(CASE WHEN coalesce(m1, 0) = 0 THEN 0.0 ELSE exp((CASE WHEN len(h) >= len(r) THEN 0.0 ELSE 1 - len(r) / len(h) END) + (ln(m1 / len(h)) + ln((m2 + 1) / (greatest(len(h) - 1, 0) + 1)) + ln((m3 + 1) / (greatest(len(h) - 2, 0) + 1)) + ln((m4 + 1) / (greatest(len(h) - 3, 0) + 1))) / 4) END, 9) AS bleu FROM t LEFT JOIN m USING (conv_id, turn)"
)
def bleu4(spark, sf_dir):
    out = text_similarity.bleu4(exchanges(spark, sf_dir), ["conv_id", "turn"], "rewritten", "source_text")
    return out.select("conv_id", "turn", _r("bleu", 9))


def _first_sql(x: str) -> str:
    return f"list_slice(string_split({normal_sql(f'lower({x})')}, ' '), 1, 12)"


@query(f"WITH {EXCHANGES_SQL} SELECT count(*) AS pairs, count(*) FILTER (WHERE {_first_sql('source_text')} = {_first_sql('rewritten')}) AS aligned FROM exchanges")
def first_words_alignment_audit(spark, sf_dir):
    rows = exchanges(spark, sf_dir)
    same = text.first_words("source_text") == text.first_words("rewritten")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(same).alias("aligned"))


# --- clusters ----------------------------------------------------------------------------------------------------

_RANKS_SQL = f"{PAIRS_SQL}, r AS (SELECT generator, conv_id, 2 * rank() OVER (ORDER BY asked) + count(*) OVER (PARTITION BY asked) - 1 AS x, 2 * rank() OVER (ORDER BY answered) + count(*) OVER (PARTITION BY answered) - 1 AS y FROM pairs)"


@query(f"WITH {_RANKS_SQL} SELECT round(corr(x, y), 9) AS rho FROM r")
def spearman_rho(spark, sf_dir):
    return cluster.spearman(pairs(spark, sf_dir), [], "asked", "answered").select(_r("rho", 9))


@query(f"WITH {PAIRS_SQL}, r AS (SELECT generator, 2 * rank() OVER (PARTITION BY generator ORDER BY asked) + count(*) OVER (PARTITION BY generator, asked) - 1 AS x, 2 * rank() OVER (PARTITION BY generator ORDER BY answered) + count(*) OVER (PARTITION BY generator, answered) - 1 AS y FROM pairs) SELECT generator, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN round(corr(x, y), 9) END AS rho FROM r GROUP BY 1")
def per_generator_rho(spark, sf_dir):
    return cluster.spearman(pairs(spark, sf_dir), ["generator"], "asked", "answered").select("generator", _r("rho", 9))


@query(f"WITH {_RANKS_SQL}, d AS (SELECT x - avg(x) OVER (PARTITION BY generator) AS x, y - avg(y) OVER (PARTITION BY generator) AS y FROM r WHERE conv_id IN (SELECT conv_id FROM r GROUP BY 1 HAVING count(*) >= 2)) SELECT round(corr(x, y), 6) AS within_rho FROM d")
def within_corr(spark, sf_dir):
    return cluster.within_correlation(pairs(spark, sf_dir), "generator", "asked", "answered", "conv_id").select(_r("within_rho"))


@query(f"WITH {PAIRS_SQL}, m AS (SELECT generator, avg(asked) AS a, avg(answered) AS b FROM pairs GROUP BY 1), r AS (SELECT 2 * rank() OVER (ORDER BY a) + count(*) OVER (PARTITION BY a) - 1 AS x, 2 * rank() OVER (ORDER BY b) + count(*) OVER (PARTITION BY b) - 1 AS y FROM m) SELECT round(corr(x, y), 9) AS between_rho FROM r")
def between_group_corr(spark, sf_dir):
    return cluster.between_correlation(pairs(spark, sf_dir), "generator", "asked", "answered").select(_r("between_rho", 9))


_CLUSTER_REPLICATES = 200


@query(
    f"WITH {PAIRS_SQL}, places AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS place FROM (SELECT DISTINCT conv_id FROM pairs)), n AS (SELECT count(*) AS n FROM places),"
    f" draws AS (SELECT rep, k AS draw, (('0x' || substr(md5('{CLUSTER_SEED}' || '|' || rep || '|' || k), 1, 15))::BIGINT % n) AS place FROM (SELECT unnest(range({_CLUSTER_REPLICATES})) AS rep), n, unnest(range(n)) AS u(k)),"
    " rows AS (SELECT rep, asked, answered FROM draws JOIN places USING (place) JOIN pairs USING (conv_id)),"
    " r AS (SELECT rep, 2 * rank() OVER (PARTITION BY rep ORDER BY asked) + count(*) OVER (PARTITION BY rep, asked) - 1 AS x, 2 * rank() OVER (PARTITION BY rep ORDER BY answered) + count(*) OVER (PARTITION BY rep, answered) - 1 AS y FROM rows),"
    " e AS (SELECT rep, corr(x, y) AS rho FROM r GROUP BY 1)"
    f" SELECT count(rho) AS replicates, round(quantile_cont(rho, 0.025), 6) AS ci_low, round(quantile_cont(rho, 0.975), 6) AS ci_high, round(least(1.0, 2 * greatest(least(avg(CASE WHEN rho <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN rho >= 0 THEN 1.0 ELSE 0.0 END)), 1.0 / {_CLUSTER_REPLICATES})), 6) AS p FROM e"
)
def cluster_bootstrap(spark, sf_dir):
    out = cluster.cluster_bootstrap(cut(pairs(spark, sf_dir)), "conv_id", "asked", "answered", _CLUSTER_REPLICATES, CLUSTER_SEED)
    return out.select("replicates", _r("ci_low"), _r("ci_high"), _r("p"))


@query()
def cluster_bootstrap_whole(spark, sf_dir):
    """The reference's 5,000 replicates; among so many some correlations are zero, which rounding in SQL puts on either side."""
    out = cluster.cluster_bootstrap(cut(pairs(spark, sf_dir)), "conv_id", "asked", "answered", 5_000, CLUSTER_SEED)
    return out.select("replicates", _r("ci_low"), _r("ci_high"), _r("p"))


# --- views -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN ({words_sql('text')}) >= 32 THEN sha256(array_to_string(list_slice(string_split({normal_sql('text')}, ' '), 1, 32), ' ')) END AS view_sha256 FROM documents")
def content_view_first_n(spark, sf_dir):
    view = views.content_view(text.words("text"), 32)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(view, " "), 256).alias("view_sha256"))


@query(f"WITH {EXCHANGES_SQL} SELECT 'view' AS gate, side AS rule, conv_id || '|' || turn AS key, n::VARCHAR AS detail FROM (SELECT conv_id, turn, 'human' AS side, {words_sql('source_text')} AS n FROM exchanges UNION ALL SELECT conv_id, turn, 'generated', {words_sql('rewritten')} FROM exchanges) WHERE n < 32")
def paired_view_gate(spark, sf_dir):
    rows = exchanges(spark, sf_dir).select("conv_id", "turn", views.token_ids("source_text").alias("human"), views.token_ids("rewritten").alias("made"))
    return gates.paired_view(rows, "view", ["conv_id", "turn"], "human", "made", 32)


def _view_aurocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of every cell on events of one part of the hours, standing in for a view length."""
    rows = table(spark, sf_dir, "events").withColumn("view", F.explode(F.array(*map(F.lit, views.VIEWS)))).where(F.col("event_id") % 128 < F.col("view"))
    cents = F.round(F.col("value") * 100).cast("long")
    totals = rows.groupBy("view", F.col("user_id").alias("source"), F.col("event_type").alias("cell")).agg(F.sum(cents).alias("value"))
    human = totals.where(F.col("cell") == HUMAN_CELL).select("view", "source", F.col("value").alias("human"))
    met = totals.where(F.col("cell") != HUMAN_CELL).join(human, ["view", "source"]).withColumn("key", F.concat_ws("/", "view", "cell"))
    out = auroc.auroc(met.select("key", "source", "human", F.col("value").alias("generated")), "key")
    return out.select(F.split_part("key", F.lit("/"), F.lit(1)).cast("int").alias("view"), F.split_part("key", F.lit("/"), F.lit(2)).alias("cell"), "auroc", "ceiling", "n_human")


_VIEWS_SQL = f"""totals AS (SELECT view, user_id AS source, event_type AS cell, sum(CAST(round(value * 100) AS BIGINT)) AS value FROM events, (SELECT unnest([128, 64, 32]) AS view) WHERE event_id % 128 < view GROUP BY 1, 2, 3),
s AS (SELECT a.view, a.cell, a.source, h.value AS human, a.value AS generated FROM totals a JOIN totals h ON h.view = a.view AND h.source = a.source AND h.cell = '{HUMAN_CELL}' WHERE a.cell <> '{HUMAN_CELL}'),
v AS (SELECT a.view, a.cell, sum(CASE WHEN a.generated > b.human THEN 2 WHEN a.generated = b.human THEN 1 ELSE 0 END) / (2.0 * count(*)) AS auroc FROM s a JOIN s b ON a.view = b.view AND a.cell = b.cell GROUP BY 1, 2)"""


@query(f'WITH {_VIEWS_SQL} SELECT cell, round(max(auroc) FILTER (WHERE view = 128), 9) AS "128", round(max(auroc) FILTER (WHERE view = 64), 9) AS "64", round(max(auroc) FILTER (WHERE view = 32), 9) AS "32" FROM v GROUP BY 1')
def view_ladder_pivot(spark, sf_dir):
    return views.ladder(_view_aurocs(spark, sf_dir)).select("cell", *[_r(str(v), 9) for v in views.VIEWS])


@query(f"WITH {_VIEWS_SQL} SELECT view, count(*) FILTER (WHERE auroc = 1) AS ceilings, count(*) FILTER (WHERE auroc = 1) >= 3 AS authorised FROM v GROUP BY 1")
def descent_rule(spark, sf_dir):
    return gates.descent(_view_aurocs(spark, sf_dir), 3)


@query(f"WITH {_VIEWS_SQL} SELECT max(view) AS primary_view FROM (SELECT view FROM v GROUP BY 1 HAVING max(auroc) < 1 AND count(*) = 4)")
def primary_view_select(spark, sf_dir):
    return gates.primary_view(_view_aurocs(spark, sf_dir), list(CELLS))


# --- figure data -------------------------------------------------------------------------------------------------


@query(f"WITH {AUROC_SQL}, {_DRAWS_SQL}, i AS (SELECT cell, quantile_cont(auroc, 0.025) AS lo, quantile_cont(auroc, 0.975) AS hi FROM samples GROUP BY 1) SELECT CASE cell WHEN 'click' THEN 'Click' WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Purchase' ELSE 'Sign-up' END AS label, round(auroc, 9) AS auroc, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, auroc >= 0.9999 AS flagged FROM auroc JOIN i USING (cell)")
def figure_series(spark, sf_dir):
    """Display labels, AUROC, interval and the plotted ceiling flag of every cell."""
    rows = cut(scores(spark, sf_dir))
    names = F.create_map(*[F.lit(x) for pair in (("click", "Click"), ("error", "Error"), ("purchase", "Purchase"), ("signup", "Sign-up")) for x in pair])
    met = auroc.auroc(rows).join(bootstrap.cell_intervals(bootstrap.samples(rows, REPLICATES, SEED)), "cell")
    return met.select(names[F.col("cell")].alias("label"), _r("auroc", 9), _r("ci_low", 9), _r("ci_high", 9), (F.col("auroc") >= 0.9999).alias("flagged"))


@query(f"WITH {PAIRS_SQL} SELECT round(regr_slope(answered, asked), 6) AS slope, round(regr_intercept(answered, asked), 4) AS intercept, round(avg(answered), 6) AS mean FROM pairs")
def figure_scatter_fit(spark, sf_dir):
    return pairs(spark, sf_dir).agg(F.round(F.regr_slope("answered", "asked"), 6).alias("slope"), F.round(F.regr_intercept("answered", "asked"), 4).alias("intercept"), F.round(F.avg("answered"), 6).alias("mean"))


@query(f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{WHITESPACE_SQL}') AS spaced, regexp_matches(sha256(text), '^[0-9a-f]{{64}}$') AS hexed FROM documents")
def pattern_predicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).rlike(text.WHITESPACE).alias("spaced"), F.sha2("text", 256).rlike(r"\A[0-9a-f]{64}\z").alias("hexed"))
