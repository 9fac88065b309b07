"""Integrity gates: every rule gives rows (gate, rule, key, detail) for what breaks it; a gate passes without rows.

Rules are joins, anti-joins, counts and predicates over whole tables; all violations are found in one plan, and
``require`` raises once, with a few of them. Exact key equality uses null-safe comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256_text, word_count
from . import locks

COLUMNS = ("gate", "rule", "key", "detail")


class GateError(ValueError):
    """A gate that has violations."""


def _rows(df: DataFrame, gate: str, rule: str, key: Column, detail: Column | str = "") -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(gate).alias("gate"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.coalesce(detail.cast("string"), F.lit("null")).alias("detail"))


def _key(columns: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))


def gather(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def require(violations: DataFrame, show: int = 5) -> None:
    """Raise when there is a violation."""
    found = violations.limit(show).collect()
    if found:
        raise GateError("; ".join(f"{r['gate']}/{r['rule']} {r['key']}: {r['detail']}" for r in found))


def predicate(df: DataFrame, gate: str, rule: str, key: list[str], holds: Column, detail: Column | str = "") -> DataFrame:
    """Rows for which ``holds`` isn't true."""
    return _rows(df.where(~F.coalesce(holds, F.lit(False))), gate, rule, _key(key), detail)


def unique(df: DataFrame, gate: str, key: list[str]) -> DataFrame:
    counted = df.groupBy(*key).count().where("count > 1")
    return _rows(counted, gate, "unique", _key(key), F.col("count"))


def coverage(expected: DataFrame, actual: DataFrame, gate: str, key: list[str]) -> DataFrame:
    """Expected keys that are missing, and keys that nothing expects."""
    a, b = expected.select(*key).distinct(), actual.select(*key).distinct()
    return gather(_rows(a.join(b, key, "left_anti"), gate, "missing", _key(key)), _rows(b.join(a, key, "left_anti"), gate, "unexpected", _key(key)))


def disjoint(a: DataFrame, b: DataFrame, gate: str, key: list[str]) -> DataFrame:
    return _rows(a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_semi"), gate, "disjoint", _key(key))


def equal_fields(left: DataFrame, right: DataFrame, gate: str, key: list[str], fields: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner, and the fields that differ from their partner's, by name."""
    other = right.select(*key, F.struct(*fields).alias("_other"))
    met = left.join(other, key, "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col("_other")[f]), F.lit(f)) for f in fields]))
    met = met.withColumn("_differs", differs)
    return gather(
        _rows(met.where(F.col("_other").isNull()), gate, "partner", _key(key)),
        _rows(met.where(F.col("_other").isNotNull() & (F.size("_differs") > 0)), gate, "fields", _key(key), F.array_join("_differs", ",")),
    )


def order(df: DataFrame, gate: str, group: list[str], position: str, item: str, expected: str) -> DataFrame:
    """Places of a list whose item isn't the expected one; lists are compared row by row, not collected."""
    return _rows(df.where(~F.col(item).eqNullSafe(F.col(expected))), gate, "order", _key([*group, position]), F.col(item))


def same_multiset(left: DataFrame, right: DataFrame, gate: str = "rows") -> DataFrame:
    """Rows of either table that the other lacks, repeats counted."""
    text = F.to_json(F.struct("*"))
    return gather(_rows(left.exceptAll(right), gate, "left only", text), _rows(right.exceptAll(left), gate, "right only", text))


def hashes(df: DataFrame, gate: str, key: list[str], text: str, digest: str) -> DataFrame:
    return predicate(df, gate, f"sha256 of {text}", key, sha256_text(text) == F.col(digest), F.col(digest))


def leaks(prompts: DataFrame, texts: DataFrame, gate: str, key: list[str], prompt: str, text: str) -> DataFrame:
    """Rows whose own text, joined by key, occurs in their prompt."""
    met = prompts.join(texts.select(*key, F.col(text).alias("_text")), key)
    return _rows(met.where((F.length("_text") > 0) & F.contains(F.col(prompt), F.col("_text"))), gate, "leak", _key(key))


def queue(rows: DataFrame, gate: str = "queue") -> DataFrame:
    """Rules of a generation queue: required fields, one row for each cohort and source, id format, hash, bounds."""
    fields = ["source_id", "compact_index", "split_origin", "cohort", "human_sha256", "topic", "topic_sha256", "target_words", "low_words", "high_words"]
    key = ["cohort", "source_id"]
    rules = {
        "required": reduce(Column.__and__, [F.col(f).isNotNull() for f in fields]),
        "source id": F.col("source_id") == F.format_string("arxiv2k:%04d", "compact_index"),
        "sha256 of topic": (sha256_text("topic") == F.col("topic_sha256"), F.col("topic_sha256")),
        "bounds": (F.col("low_words") <= F.col("target_words")) & (F.col("target_words") <= F.col("high_words")),
        "split": F.col("split_origin").isin("train", "val", "test"),
    }
    return gather(unique(rows, gate, key), compiled(rows, gate, key, rules))


def result_cell(endpoints: DataFrame, queued: DataFrame, contract: DataFrame, gate: str = "result") -> DataFrame:
    """Rules of a cell's endpoints: one first attempt a source, queue and contract fields, status, tokens, hashes.

    ``contract`` has a row for each (suite, cell) with run_id, cohort, phase, model_hf_id, model_revision, tokens.
    """
    key = ["suite", "cell", "source_id"]
    own = ["suite", "cell"]
    fields = ["run_id", "cohort", "phase", "model_hf_id", "model_revision"]
    met = endpoints.join(F.broadcast(contract.select(*own, "tokens")), own, "left")
    wanted = contract.select(*own, "cohort").join(queued.select("cohort", "source_id"), "cohort").select(*key)
    return gather(
        unique(endpoints, gate, key),
        predicate(endpoints, gate, "attempt", key, F.col("attempt") == 0, F.col("attempt")),
        coverage(wanted, endpoints, gate, key),
        equal_fields(endpoints, queued, gate, ["cohort", "source_id"], ["human_sha256", "topic_sha256", "compact_index", "split_origin"]),
        equal_fields(endpoints, contract, gate, own, fields),
        predicate(endpoints, gate, "phase", key, F.col("phase").isin("smoke", "pilot", "main") & ((F.col("cohort") == "main") == (F.col("phase") == "main"))),
        predicate(endpoints, gate, "status", key, F.col("status") == "accepted", F.col("status")),
        predicate(met, gate, "tokens", key, (F.size("output_token_ids") == F.col("tokens")) & (F.col("output_tokens") == F.col("tokens"))),
        hashes(endpoints, gate, key, "raw_output", "raw_output_sha256"),
        hashes(endpoints, gate, key, "normalized_output", "normalized_output_sha256"),
        predicate(endpoints, gate, "words", key, F.col("actual_words") == word_count("normalized_output")),
    )


def positions(rows: DataFrame, gate: str, place: str, many: int, rules: dict[str, Column]) -> DataFrame:
    """Rules of a file by position: as many rows as wanted, numbered without gaps, and what each place has to hold."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(place).alias("places"), F.min(place).alias("least"), F.max(place).alias("most"))
    whole = (F.col("n") == many) & (F.col("places") == many) & ((F.col("least") == 0) | (F.lit(many) == 0)) & ((F.col("most") == many - 1) | (F.lit(many) == 0))
    return gather(predicate(total, gate, "rows", ["n"], whole), compiled(rows, gate, [place], rules))


def zipped(left: DataFrame, right: DataFrame, gate: str, place: str, rules: dict[str, Column]) -> DataFrame:
    """Two files row by row: places that one of them lacks, and rules over the columns of both (the right's as ``_other``)."""
    met = left.withColumn("_left", F.lit(True)).join(right.select(F.col(place), F.struct(*[c for c in right.columns if c != place]).alias("_other")), place, "full")
    both = met.where(F.col("_left") & F.col("_other").isNotNull())
    return gather(_rows(met.where(F.col("_left").isNull()), gate, "left", _key([place])), _rows(met.where(F.col("_other").isNull()), gate, "right", _key([place])), compiled(both, gate, [place], rules))


def matched_texts(rows: DataFrame, humans: DataFrame, gate: str, index: str, text: str, needed: str) -> DataFrame:
    """Rows that name a human text by its index: one row each, all texts covered, the text itself repeated, ``needed`` not blank.

    ``humans`` has the index and the text as ``text``. Texts meet by index and are compared whole; they are found the
    other way too: an index whose text stands at another index is told with it.
    """
    own = humans.select(F.col(index), F.col("text").alias("_text"))
    met = rows.join(own, index, "left")
    wrong = met.where(F.col("_text").isNotNull() & ~F.col(text).eqNullSafe(F.col("_text"))).select(index, sha256_text(text).alias("_sha"))
    at = humans.groupBy(sha256_text("text").alias("_sha")).agg(F.min(index).alias("_at"))
    moved = wrong.join(at, "_sha", "left")
    return gather(
        unique(rows, gate, [index]),
        coverage(humans, rows, gate, [index]),
        _rows(moved, gate, "text", _key([index]), F.coalesce(F.col("_at").cast("string"), F.lit("nowhere"))),
        predicate(rows, gate, f"{needed} blank", [index], F.length(F.trim(needed)) > 0),
    )


def compiled(rows: DataFrame, gate: str, key: list[str], rules: dict[str, Column] | dict[str, tuple[Column, Column]]) -> DataFrame:
    """Violations of all row rules in one scan: each row lists the rules that don't hold, and the list is exploded.

    A rule is a condition, or a condition and the detail that is told. A condition that is null doesn't hold.
    """
    if not rules:
        return rows.sparkSession.createDataFrame([], "gate string, rule string, key string, detail string")
    told = []
    for name, rule in rules.items():
        holds, detail = rule if isinstance(rule, tuple) else (rule, F.lit(""))
        told.append(F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.coalesce(detail.cast("string"), F.lit("null")).alias("detail"))))
    broken = rows.select(_key(key).alias("key"), F.explode(F.array_compact(F.array(*told))).alias("b"))
    return broken.select(F.lit(gate).alias("gate"), "b.rule", "key", "b.detail")


def panel(endpoints: DataFrame, cells: DataFrame, gate: str = "panel") -> DataFrame:
    """Exactly the wanted cells, and every cell with the sources, human hashes and splits of the whole panel."""
    own = ["suite", "cell"]
    sources = endpoints.select("source_id", "human_sha256", "split_origin").distinct()
    # a source's cells are at most those that the panel wants, a short list
    wanted = cells.agg(F.collect_set(F.struct(*own)).alias("wanted"))
    known = endpoints.join(cells.select(*own).distinct(), own, "left_semi").select("source_id", F.struct(*own).alias("cell"))
    has = endpoints.select("source_id").distinct().join(known.groupBy("source_id").agg(F.collect_set("cell").alias("has")), "source_id", "left")
    absent = has.join(F.broadcast(wanted)).select("source_id", F.explode(F.array_except("wanted", F.coalesce("has", F.array().cast(wanted.schema["wanted"].dataType)))).alias("c"))
    stray = endpoints.join(cells.select(*own).distinct(), own, "left_anti").select(*own, "source_id").distinct()
    every = [*own, "source_id"]
    return gather(
        coverage(cells, endpoints, gate, own),
        _rows(absent.select(*(F.col(f"c.{x}").alias(x) for x in own), "source_id"), f"{gate} sources", "missing", _key(every)),
        _rows(stray, f"{gate} sources", "unexpected", _key(every)),
        unique(sources, f"{gate} identities", ["source_id"]),
    )


def files(found: DataFrame, pinned: DataFrame, gate: str = "files") -> DataFrame:
    """Pinned files (name, length, sha256, sha1) against found ones: exact set, sizes and digests."""
    fields = [c for c in ("length", "sha256", "sha1") if c in pinned.columns]
    both = found.join(pinned.select("name"), "name", "left_semi")
    return gather(coverage(pinned, found, gate, ["name"]), equal_fields(both, pinned, gate, ["name"], fields))


def paired_view(rows: DataFrame, gate: str, key: list[str], human_ids: str, made_ids: str, required: int) -> DataFrame:
    """Both sides of a pair have enough content tokens."""
    return gather(*[predicate(rows, gate, side, key, F.size(ids) >= required, F.size(ids)) for side, ids in (("human", human_ids), ("generated", made_ids))])


def locked(current: DataFrame, lock: DataFrame, gate: str = "lock") -> DataFrame:
    """(path, digest) rows of now against those of a lock."""
    return gather(coverage(lock, current, gate, ["path"]), equal_fields(current.join(lock.select("path"), "path", "left_semi"), lock, gate, ["path"], ["digest"]))


def lock_digest(rows: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """The root (lock_sha256) of the Merkle tree over all (path, digest) rows, whatever their order and partitions."""
    return locks.build(rows, path, digest, keep=False).root().select("lock_sha256")


def descent(aurocs: DataFrame, threshold: int) -> DataFrame:
    """view, ceiling cells, whether so many authorise the next shorter view."""
    return aurocs.groupBy("view").agg(F.count_if("ceiling").alias("ceilings")).withColumn("authorised", F.col("ceilings") >= threshold)


def primary_view(aurocs: DataFrame, cells: list[str]) -> DataFrame:
    """The longest view whose named cells are all below the ceiling; null if there is none."""
    below = aurocs.where(F.col("cell").isin(cells)).groupBy("view").agg(F.bool_and(~F.col("ceiling")).alias("below"), F.count_distinct("cell").alias("n"))
    return below.agg(F.max(F.when(F.col("below") & (F.col("n") == len(cells)), F.col("view"))).alias("primary_view"))
