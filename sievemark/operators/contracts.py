"""Contracts of runs: prompts, exemplars, hashes without a field, fingerprints of code, bindings of artifacts, cells of rewrites.

Gates give rows of violations as those in ``gates``. A contract is a row; hashes are of canonical JSON.
"""

from __future__ import annotations

from importlib import metadata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace, sha256_text, word_count
from . import gates


def is_finite(value: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def finite(rows: DataFrame, gate: str, key: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose values are all finite, and a violation for each value that isn't."""
    kept = rows
    for v in values:
        kept = kept.where(is_finite(v))
    return kept, gates.gather(*[gates.predicate(rows, gate, f"finite {v}", key, is_finite(v), F.col(v)) for v in values])


def first_preferred(rows: DataFrame, group: list[str], name: str, preference: list[str]) -> DataFrame:
    """group and the first name of the preference list that it has; groups with none of them have no row."""
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col(name))
    return rows.where(rank > 0).groupBy(*group).agg(F.min_by(name, rank).alias(name))


def hash_without(row: Column, *excluded: str) -> Column:
    """SHA-256 of the canonical JSON of a struct less some fields, as of a contract that holds its own hash.

    The struct's fields have to be in the order of their names.
    """
    return F.sha2(F.to_json(row.dropFields(*excluded), {"ignoreNullFields": "false"}), 256)


def prompt_contract(exemplars: DataFrame, group: list[str], number: str, fields: list[str], example: Column, template: str, example_template: str, version: str, task: str | None = None) -> DataFrame:
    """One row per group: hashes of both templates, of the bundle of its examples, and of the exemplars' own fields."""
    own = F.struct(F.col(number).alias("n"), example.alias("text"), F.struct(*sorted(fields)).alias("own"))
    rows = exemplars.groupBy(*group).agg(F.array_sort(F.collect_list(own)).alias("all"))
    fixed = {"prompt_version": version, "template_sha256": F.sha2(F.lit(template), 256), "example_template_sha256": F.sha2(F.lit(example_template), 256), "surface": "plain_completion"} | ({"task": task} if task else {})
    bundle = F.array_join(F.transform("all", lambda x: x["text"]), "\n\n")
    hashed = F.sha2(F.to_json(F.transform("all", lambda x: x["own"]), {"ignoreNullFields": "false"}), 256)
    return rows.select(*group, sha256_text(bundle).alias("exemplar_bundle_sha256"), hashed.alias("exemplar_contract_sha256"), *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fixed.items()))


def exemplars(rows: DataFrame, group: list[str], gate: str = "exemplars", many: int = 1) -> DataFrame:
    """Rules of exemplars (source_id, text, word_count, human_sha256, topic, topic_sha256): how many, words, hashes."""
    key = ["source_id"]
    counted = rows.groupBy(*group).count()
    return gates.gather(
        gates.predicate(counted, gate, "how many", group, F.col("count") == many, F.col("count")),
        gates.predicate(rows, gate, "word count", key, word_count("text") == F.col("word_count"), F.col("word_count")),
        gates.hashes(rows, gate, key, "text", "human_sha256"),
        gates.hashes(rows, gate, key, "topic", "topic_sha256"),
    )


def fingerprint(spark: SparkSession, files: DataFrame, distributions: list[str]) -> DataFrame:
    """(path, digest) of code files (name, sha256) and (package, version) of installed distributions, to be locked.

    A distribution that isn't installed gives a null digest, which no lock equals.
    """

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    packages = spark.createDataFrame([(f"package:{d}", version(d)) for d in distributions], "path string, digest string")
    return files.select(F.col("name").alias("path"), F.col("sha256").alias("digest")).unionByName(packages)


def bound_artifacts(artifacts: DataFrame, manifests: DataFrame, released: DataFrame, key: list[str], gate: str = "binding") -> DataFrame:
    """Artifacts (key, sha256) whose digest isn't the one of their manifest, or isn't the one that the release used."""
    return gates.gather(
        gates.equal_fields(artifacts, manifests, f"{gate} manifest", key, ["sha256"]),
        gates.equal_fields(artifacts, released, f"{gate} release", key, ["sha256"]),
        gates.coverage(manifests, artifacts, gate, key),
    )


def contract_rows(contracts: DataFrame, wanted: DataFrame, gate: str = "contract", phases: tuple[str, ...] = ("smoke", "pilot", "main")) -> DataFrame:
    """Rules of contracts (suite, cell, run_id, phase, cohort, task, account, hashes, model) against what a panel wants of each cell."""
    key = ["suite", "cell"]
    fields = ["run_id", "task", "account_alias", "queue_sha256", "prompt_contract_sha256", "config_sha256", "model_hf_id", "model_revision"]
    own_hash = F.sha2(F.to_json(F.struct(*sorted(c for c in contracts.columns if c != "contract_sha256")), {"ignoreNullFields": "false"}), 256)
    return gates.gather(
        gates.coverage(wanted, contracts, gate, key),
        gates.unique(contracts, gate, key),
        gates.equal_fields(contracts, wanted, gate, key, fields),
        gates.predicate(contracts, gate, "phase", key, F.col("phase").isin(*phases), F.col("phase")),
        gates.predicate(contracts, gate, "cohort", key, F.col("cohort") == F.when(F.col("phase") == "main", "main").otherwise("pilot"), F.col("cohort")),
        gates.predicate(contracts, gate, "own hash", key, own_hash == F.col("contract_sha256"), F.col("contract_sha256")),
    )


def frozen_ids(listed: DataFrame, queue: DataFrame, counts: dict[str, int], gate: str = "frozen ids") -> DataFrame:
    """A contract's ids (suite, cell, phase, position, source_id) have to be the first of its cohort's queue, in order, as many as its phase has.

    ``queue`` has cohort, source_id and position from 0; lists are compared row by row, not collected.
    """
    key = ["suite", "cell"]
    sizes = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(n))])
    cohort = F.when(F.col("phase") == "main", "main").otherwise("pilot")
    cells = listed.select(*key, "phase").distinct().withColumn("cohort", cohort).withColumn("many", sizes[F.col("phase")])
    wanted = cells.join(queue.select("cohort", "position", F.col("source_id").alias("wanted")), "cohort").where("position < many").select(*key, "position", "wanted")
    met = wanted.join(listed.select(*key, "position", "source_id"), [*key, "position"], "full")
    return gates.gather(gates.unique(listed, gate, [*key, "source_id"]), gates.order(met, gate, key, "position", "source_id", "wanted"))


def rewrite_cell(endpoints: DataFrame, queued: DataFrame, contract: DataFrame, tokens: int, gate: str = "rewrite") -> DataFrame:
    """Rules of a rewrite cell's endpoints against queue and contract.

    ``queued`` has source_id, human_sha256, topic_sha256, compact_index, split_origin and the sha256 of its rendered
    prompt; ``contract`` one row per cell, with the fields that each endpoint repeats.
    """
    key, cell = ["suite", "cell", "source_id"], ["suite", "cell"]
    return gates.gather(
        gates.unique(endpoints, gate, key),
        gates.equal_fields(endpoints, contract, gate, cell, ["contract_sha256", "run_id", "cohort", "phase", "model_hf_id", "model_revision"]),
        gates.equal_fields(endpoints, queued, gate, ["source_id"], ["human_sha256", "topic_sha256", "compact_index", "split_origin", "prompt_sha256"]),
        gates.predicate(endpoints, gate, "sole attempt", key, (F.col("attempt") == 0) & (F.col("status") == "accepted"), F.col("status")),
        gates.predicate(endpoints, gate, "tokens", key, (F.col("output_tokens") == tokens) & (F.size("output_token_ids") == tokens) & F.col("exact_token_count"), F.col("output_tokens")),
        gates.predicate(endpoints, gate, "output", key, (F.length("normalized_output") > 0) & (normalize_whitespace("raw_output") == F.col("normalized_output"))),
        gates.hashes(endpoints, gate, key, "raw_output", "raw_output_sha256"),
        gates.hashes(endpoints, gate, key, "normalized_output", "normalized_output_sha256"),
    )


def completion(summaries: DataFrame, contract: DataFrame, endpoints: DataFrame, splits: dict[str, int], gate: str = "completion") -> DataFrame:
    """Rules of a cell's summary: bound to its contract, every source accepted, and the main phase's shares of splits."""
    key = ["suite", "cell"]
    counted = endpoints.groupBy(*key).agg(F.count(F.lit(1)).alias("sources"))
    met = summaries.join(counted, key, "left")
    full = F.col("complete") & (F.col("exhausted_sources") == 0)
    for c in ("requested_sources", "completed_sources", "accepted_sources"):
        full = full & (F.col(c) == F.col("sources"))
    of_split = endpoints.where(F.col("phase") == "main").groupBy(*key, "split_origin").count()
    wanted = F.create_map(*[x for k, n in splits.items() for x in (F.lit(k), F.lit(n))])
    return gates.gather(
        gates.coverage(contract, summaries, gate, key),
        gates.equal_fields(summaries, contract, gate, key, ["contract_sha256", "cohort", "phase"]),
        gates.predicate(met, gate, "full acceptance", key, full),
        gates.predicate(of_split, gate, "splits", [*key, "split_origin"], F.col("count") == wanted[F.col("split_origin")], F.col("count")),
    )


def gate_run(violations: DataFrame) -> DataFrame:
    """gate, rule, violations and status of all gates that ran: one row ``all`` and one per broken rule."""
    broken = violations.groupBy("gate", "rule").agg(F.count(F.lit(1)).alias("violations"))
    whole = violations.agg(F.lit("all").alias("gate"), F.lit("").alias("rule"), F.count(F.lit(1)).alias("violations"))
    return broken.unionByName(whole).withColumn("status", F.when(F.col("violations") == 0, "PASSED").otherwise("FAILED"))
