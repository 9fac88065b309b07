"""Queries of contracts, preferences, finite values, bootstraps of pairs, and verdicts; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cluster, contracts, gates, manifests, page, views
from ..session import cut
from .catalogue import ALPHA, CLUSTER_SEED, _r, query
from .tables import MANIFEST_SQL, blocks, manifest, normal_sql, pairs, table

# fixed values: the preference and the templates of these queries
PREFERENCE = ["purchase", "signup", "click"]
TEMPLATE = "{examples}Topic: {topic}"
EXAMPLE = "Example {number}: {topic}"


@query("SELECT user_id, CASE min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 END) WHEN 1 THEN 'purchase' WHEN 2 THEN 'signup' ELSE 'click' END AS event_type FROM events WHERE event_type IN ('purchase', 'signup', 'click') GROUP BY 1")
def preference_pick(spark, sf_dir):
    """Each user's first event type in an order of preference."""
    return contracts.first_preferred(table(spark, sf_dir, "events"), ["user_id"], "event_type", PREFERENCE)


_ODD = "CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL ELSE value END"


@query(f"WITH x AS (SELECT event_type, {_ODD} AS odd FROM events) SELECT event_type, count(*) FILTER (WHERE odd IS NOT NULL AND isfinite(odd)) AS kept, count(*) FILTER (WHERE odd IS NULL OR NOT isfinite(odd)) AS rejected FROM x GROUP BY 1")
def finite_filter(spark, sf_dir):
    """Values that aren't finite, put in by id: kept rows and rejected ones of every type."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_ODD).alias("odd"))
    kept, rejected = contracts.finite(rows, "events", ["event_type", "event_id"], ["odd"])
    a = kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
    b = rejected.groupBy(F.split_part("key", F.lit("|"), F.lit(1)).alias("event_type")).agg(F.count(F.lit(1)).alias("rejected"))
    return a.join(b, "event_type", "full").na.fill(0, ["kept", "rejected"])


@query(
    f"WITH {MANIFEST_SQL}, n AS (SELECT lang, topic, source_id, human_sha256, topic_sha256, row_number() OVER (PARTITION BY lang ORDER BY compact_index) AS n FROM manifest)"
    f" SELECT lang, 'v1' AS prompt_version, 'plain_completion' AS surface, sha256('{TEMPLATE}') AS template_sha256, sha256('{EXAMPLE}') AS example_template_sha256,"
    " sha256(string_agg('Example ' || n || ': ' || coalesce(topic, ''), chr(10) || chr(10) ORDER BY n)) AS exemplar_bundle_sha256,"
    """ sha256('[' || string_agg('{"human_sha256":' || coalesce('"' || human_sha256 || '"', 'null') || ',"source_id":"' || source_id || '","topic_sha256":' || coalesce('"' || topic_sha256 || '"', 'null') || '}', ',' ORDER BY n) || ']') AS exemplar_contract_sha256"""
    " FROM n WHERE n <= 3 GROUP BY 1"
)
def prompt_contract(spark, sf_dir):
    """The contract of a prompt for each language, its first three sources being the exemplars."""
    rows = manifest(spark, sf_dir).select("lang", "compact_index", "topic", "source_id", "human_sha256", "topic_sha256")
    first = manifests.numbered_in_group(rows, ["lang"], ["compact_index"], "n").where("n <= 3")
    example = text.render(EXAMPLE, number=F.col("n").cast("string"), topic=F.coalesce("topic", F.lit("")))
    return contracts.prompt_contract(first, ["lang"], "n", ["human_sha256", "source_id", "topic_sha256"], example, TEMPLATE, EXAMPLE, "v1")


@query(
    f"WITH {MANIFEST_SQL}, x AS (SELECT source_id, lang, text, topic, human_sha256, human_word_count + CASE WHEN compact_index % 7 = 0 THEN 1 ELSE 0 END AS word_count, CASE WHEN compact_index % 5 = 0 THEN '0' ELSE topic_sha256 END AS topic_sha256, human_word_count AS w FROM manifest)"
    " SELECT 'exemplars' AS gate, 'how many' AS rule, coalesce(lang, 'null') AS key, count(*)::VARCHAR AS detail FROM x GROUP BY lang HAVING count(*) <> 1"
    " UNION ALL SELECT 'exemplars', 'word count', source_id, coalesce(word_count::VARCHAR, 'null') FROM x WHERE (w = word_count) IS NOT TRUE"
    " UNION ALL SELECT 'exemplars', 'sha256 of text', source_id, coalesce(human_sha256, 'null') FROM x WHERE (sha256(text) = human_sha256) IS NOT TRUE"
    " UNION ALL SELECT 'exemplars', 'sha256 of topic', source_id, coalesce(topic_sha256, 'null') FROM x WHERE (sha256(topic) = topic_sha256) IS NOT TRUE"
)
def exemplar_gate(spark, sf_dir):
    """All sources taken as exemplars of their language, with wrong counts and hashes put in by number."""
    rows = manifest(spark, sf_dir)
    rows = rows.select("source_id", "lang", "text", "topic", "human_sha256", (F.col("human_word_count") + F.when(F.col("compact_index") % 7 == 0, 1).otherwise(0)).alias("word_count"), F.when(F.col("compact_index") % 5 == 0, "0").otherwise(F.col("topic_sha256")).alias("topic_sha256"))
    return contracts.exemplars(rows, ["lang"])


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS contract_sha256 FROM documents""")
def hash_without_field(spark, sf_dir):
    """A row's hash over its fields but the hash itself."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.sha256_text("text").alias("own_sha256"))
    return rows.select("doc_id", contracts.hash_without(F.struct("doc_id", "lang", "own_sha256", "source"), "own_sha256").alias("contract_sha256"))


@query(
    "WITH a AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE sha256 END AS sha256 FROM a WHERE doc_id % 4 > 0), r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '0' ELSE sha256 END AS sha256 FROM a)"
    " SELECT 'binding manifest' AS gate, 'partner' AS rule, doc_id::VARCHAR AS key, '' AS detail FROM a WHERE doc_id NOT IN (SELECT doc_id FROM m)"
    " UNION ALL SELECT 'binding manifest', 'fields', a.doc_id::VARCHAR, 'sha256' FROM a JOIN m USING (doc_id) WHERE a.sha256 IS DISTINCT FROM m.sha256"
    " UNION ALL SELECT 'binding release', 'fields', a.doc_id::VARCHAR, 'sha256' FROM a JOIN r USING (doc_id) WHERE a.sha256 IS DISTINCT FROM r.sha256"
    " UNION ALL SELECT 'binding', 'unexpected', doc_id::VARCHAR, '' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM m)"
)
def artifact_binding(spark, sf_dir):
    """Texts as artifacts, with a manifest that lacks some and errs on others, and a release that errs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.sha256_text("text").alias("sha256"))
    wrong = lambda n: rows.withColumn("sha256", F.when(F.col("doc_id") % n == 0, "0").otherwise(F.col("sha256")))
    return contracts.bound_artifacts(rows, wrong(3).where("doc_id % 4 > 0"), wrong(5), ["doc_id"])


@query("WITH w AS (SELECT user_id % 10 AS generator, extract('hour' FROM ts) // 6 AS win, avg(value) AS v FROM events GROUP BY 1, 2) SELECT win::BIGINT AS win, round(avg(v), 6) AS mean_value, count(*) AS generators FROM w GROUP BY 1")
def token_window_anatomy(spark, sf_dir):
    """Ten generators' means in four windows, and the mean over generators."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("generator"), F.floor(F.hour("ts") / 6).alias("win"), "value")
    each = rows.groupBy("generator", "win").agg(F.avg("value").alias("v"))
    return each.groupBy("win").agg(F.avg("v").alias("mean_value"), F.count(F.lit(1)).alias("generators")).select("win", _r("mean_value"), "generators")


_POOLED = 12


@query(
    f"WITH w AS (SELECT doc_id, string_split({normal_sql('text')}, ' ')[1:{_POOLED}] AS words FROM documents WHERE text IS NOT NULL AND {normal_sql('text')} <> ''),"
    " t AS (SELECT doc_id, ('0x' || substr(md5(unnest(words)), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS token FROM w),"
    " v AS (SELECT vec_id AS token, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),"
    " n AS (SELECT doc_id, count(*) AS kept FROM t GROUP BY 1),"
    f" m AS (SELECT doc_id, list(s ORDER BY d) AS mean FROM (SELECT doc_id, d, sum(v) / {_POOLED}.0 AS s FROM t JOIN v USING (token) GROUP BY 1, 2) GROUP BY 1)"
    f" SELECT doc_id, kept, CASE WHEN kept = {_POOLED} THEN 'ok' ELSE 'count' END AS status, CASE WHEN kept = {_POOLED} THEN round(mean[1], 6) END AS head, CASE WHEN kept = {_POOLED} THEN round(mean[-1], 6) END AS tail, CASE WHEN kept = {_POOLED} THEN round(sqrt(list_sum(list_transform(mean, lambda x: x * x))), 6) END AS norm"
    " FROM n LEFT JOIN m USING (doc_id)"
)
def masked_mean_pooling(spark, sf_dir):
    """Documents' first words as tokens between boundaries and padding, pooled over the embeddings as a table of weights."""
    weights = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    many = weights.count()
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.slice(text.words("text"), 1, _POOLED).alias("words"))
    # written once, as kept tokens, the others and the filter come from it: texts are cut to words in one pass
    own = cut(own).where(F.size("words") > 0)
    token = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(max(many, 1)))
    inner = own.select("doc_id", F.explode("words").alias("w")).select("doc_id", token.alias("token"), F.lit(True).alias("keep"))
    # boundaries and padding, which the mask leaves out
    outer = own.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1)).cast("array<long>")).alias("token"), F.lit(False).alias("keep"))
    pooled = views.masked_mean(inner.unionByName(outer), weights, ["doc_id"], _POOLED, 64)
    return pooled.select("doc_id", F.col("kept").cast("long").alias("kept"), "status", F.round(F.element_at("mean", 1), 6).alias("head"), F.round(F.element_at("mean", -1), 6).alias("tail"), F.round(F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


def _bootstrapped(out, *keys: str):
    return out.select(*keys, "pairs", _r("rho"), _r("ci_low"), _r("ci_high"), _r("p"))


@query()
def per_group_bootstrap(spark, sf_dir):
    """Pairs drawn anew within each generator, 5,000 times."""
    return _bootstrapped(cluster.group_bootstrap(cut(pairs(spark, sf_dir)), ["generator"], ["conv_id", "asked", "answered"], "asked", "answered", 5_000, CLUSTER_SEED), "generator")


@query()
def pair_bootstrap(spark, sf_dir):
    """Pairs of the whole table drawn anew, 5,000 times, as for stored pairs with one of a source."""
    return _bootstrapped(cluster.group_bootstrap(cut(pairs(spark, sf_dir)), [], ["conv_id", "generator", "asked", "answered"], "asked", "answered", 5_000, CLUSTER_SEED))


@query()
def generator_cluster_bootstrap(spark, sf_dir):
    """Whole generators drawn anew, 5,000 times."""
    out = cluster.cluster_bootstrap(cut(pairs(spark, sf_dir)), "generator", "asked", "answered", 5_000, CLUSTER_SEED)
    return out.select("replicates", _r("ci_low"), _r("ci_high"), _r("p"))


@query()
def page_verdict(spark, sf_dir):
    """The label of the trend over cells ordered by name, from the exact tail and the audit of hidden orders."""
    rows = blocks(spark, sf_dir).where("cell <> 'view'").select(F.lit("scale").alias("suite"), "source", F.col("value").cast("double").alias("value"), "cell")
    order = F.array(*map(F.lit, ("click", "error", "purchase", "signup")))
    rows = rows.withColumn("x", F.array_position(order, F.col("cell")))
    whole = rows.groupBy("source").count().where("count = 4").select("source")
    rows = cut(rows.join(whole, "source").withColumn("top", F.lit(False)))
    tests = page.p_test(rows, ["suite"], "source", "x", "value")
    return page.verdict(tests, page.ceiling_audit(rows, "suite", "source", "x", "value", "top", ALPHA), "suite", ALPHA)


@query("SELECT 'all' AS gate, '' AS rule, count(*) AS violations, CASE WHEN count(*) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT 1 FROM documents GROUP BY sha256(text) HAVING count(*) > 1) UNION ALL SELECT 'texts', 'unique', count(*), 'FAILED' FROM (SELECT 1 FROM documents GROUP BY sha256(text) HAVING count(*) > 1) HAVING count(*) > 0")
def gate_run(spark, sf_dir):
    """The log of a gate over all texts."""
    return contracts.gate_run(gates.unique(table(spark, sf_dir, "documents").select(text.sha256_text("text").alias("human_sha256")), "texts", ["human_sha256"]))
