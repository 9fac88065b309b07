"""Validators of whole cells of results: every rule on contracts, endpoints and summaries, in one scan of each table.

A rule is a named condition on a joined row (``gates.compiled``): endpoints meet their queue row, their contract and
what the panel wants of the cell once, whatever the number of rules. Contracts, one a cell, are few and go to every task, as a cell has any number
of endpoints, which would meet in one. Rules on sets (files of a source, sources of a cell, splits) are aggregates. All violations come out, as rows of gate, rule, key and detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace, sha256_text
from . import gates
from .gates import _key, _rows

# fixed values: phases, and the shares of splits of the main one
PHASES = ("smoke", "pilot", "main")
MAIN_SPLITS = {"train": 352, "val": 69, "test": 79}
_CELL = ["suite", "cell"]
_SOURCE = [*_CELL, "source_id"]


def cohort_of(phase: str | Column) -> Column:
    return F.when(F.col(phase) == "main", "main").otherwise("pilot") if isinstance(phase, str) else F.when(phase == "main", "main").otherwise("pilot")


def own_hash(contracts: DataFrame) -> Column:
    """SHA-256 of the canonical JSON of a contract's row without the hash that it holds."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in contracts.columns if c != "contract_sha256")), {"ignoreNullFields": "false"}), 256)


def contract_rules(contracts: DataFrame, wanted: DataFrame, gate: str = "contract") -> DataFrame:
    """Contracts (suite, cell, run_id, account_alias, phase, cohort, config_sha256, model_hf_id, model_revision, contract_sha256).

    ``wanted`` has suite, cell, run_id, account_alias, config_sha256, model_hf_id, model_revision and phase, which is
    null where any phase will do.
    """
    fields = ["run_id", "account_alias", "config_sha256", "model_hf_id", "model_revision"]
    want = wanted.select(*_CELL, F.struct(*fields, "phase").alias("_want"))
    met = contracts.withColumn("_own", own_hash(contracts)).join(F.broadcast(want), _CELL, "left")
    w = lambda c: F.col("_want")[c]
    rules = {
        "wanted": F.col("_want").isNotNull(),
        **{f: (F.col("_want").isNull() | F.col(f).eqNullSafe(w(f)), F.col(f)) for f in fields},
        "phase": (F.col("phase").isin(*PHASES), F.col("phase")),
        "phase wanted": (w("phase").isNull() | (F.col("phase") == w("phase")), F.col("phase")),
        "cohort": (F.col("cohort") == cohort_of("phase"), F.col("cohort")),
        "own hash": (F.col("_own") == F.col("contract_sha256"), F.col("contract_sha256")),
    }
    return gates.gather(gates.coverage(wanted, contracts, gate, _CELL), gates.unique(contracts, gate, _CELL), gates.compiled(met, gate, _CELL, rules))


def listed_rules(listed: DataFrame, contracts: DataFrame, queue: DataFrame, gate: str = "listed") -> DataFrame:
    """A contract's ids (suite, cell, position, source_id): none twice, all queued; the main phase lists its whole cohort in order.

    ``queue`` has cohort, source_id and compact_index; the main cohort's list is in the order of compact_index from 0.
    """
    cells = contracts.select(*_CELL, "phase", cohort_of("phase").alias("cohort"))
    rows = listed.join(F.broadcast(cells), _CELL).join(queue.select("source_id", F.col("cohort").alias("_cohort"), F.col("compact_index").alias("_index")), "source_id", "left")
    rules = {
        "queued": F.col("_cohort").isNotNull(),
        "order": ((F.col("phase") != "main") | (F.col("_index") == F.col("position")), F.col("_index")),
    }
    whole = queue.where("cohort = 'main'").select("cohort", "source_id").join(F.broadcast(cells.where("phase = 'main'")), "cohort").select(*_SOURCE)
    lacks = whole.join(listed.select(*_SOURCE), _SOURCE, "left_anti")
    return gates.gather(gates.unique(listed, gate, _SOURCE), gates.compiled(rows, gate, [*_CELL, "position"], rules), _rows(lacks, gate, "main lacks", _key(_SOURCE)))


def endpoint_rules(endpoints: DataFrame, contracts: DataFrame, queue: DataFrame, listed: DataFrame, tokens: int, gate: str = "endpoint") -> DataFrame:
    """Endpoints (``sources.files.ENDPOINT`` and file) of sources that contracts list.

    ``queue`` has source_id, human_sha256, topic_sha256, compact_index, split_origin and the sha256 of the rendered
    prompt. A source has exactly the file attempt-00.json. Twenty rules are evaluated in one scan.
    """
    repeated = ["contract_sha256", "run_id", "cohort", "phase", "model_hf_id", "model_revision"]
    own = ["human_sha256", "topic_sha256", "compact_index", "split_origin"]
    met = endpoints.join(F.broadcast(contracts.select(*_CELL, F.struct(*repeated).alias("_contract"))), _CELL, "left").join(queue.select("source_id", F.struct(*own, "prompt_sha256").alias("_queued")), "source_id", "left")
    c, q = (lambda f: F.col("_contract")[f]), (lambda f: F.col("_queued")[f])
    absent = F.col("_contract").isNull(), F.col("_queued").isNull()
    rules = {
        "contract": ~absent[0],
        "queued": ~absent[1],
        **{f: (absent[0] | F.col(f).eqNullSafe(c(f)), F.col(f)) for f in repeated},
        **{f: (absent[1] | F.col(f).eqNullSafe(q(f)), F.col(f)) for f in own},
        "attempt": (F.col("attempt") == 0, F.col("attempt")),
        "status": (F.col("status") == "accepted", F.col("status")),
        "tokens": (F.col("output_tokens") == tokens, F.col("output_tokens")),
        "token ids": (F.size("output_token_ids") == tokens, F.size("output_token_ids")),
        "exact": F.col("exact_token_count"),
        "empty": F.length("normalized_output") > 0,
        "normal form": normalize_whitespace("raw_output") == F.col("normalized_output"),
        "raw hash": (sha256_text("raw_output") == F.col("raw_output_sha256"), F.col("raw_output_sha256")),
        "normal hash": (sha256_text("normalized_output") == F.col("normalized_output_sha256"), F.col("normalized_output_sha256")),
        "prompt": (absent[1] | (q("prompt_sha256") == F.col("prompt_sha256")), F.col("prompt_sha256")),
    }
    # files of a source and listed sources meet in one aggregate
    sides = endpoints.select(*_SOURCE, "file", F.lit(0).alias("listed")).unionByName(listed.select(*_SOURCE, F.lit(None).cast("string").alias("file"), F.lit(1).alias("listed")))
    held = sides.groupBy(*_SOURCE).agg(F.count("file").alias("files"), F.count_if(F.col("file") == "attempt-00.json").alias("first"), F.max("listed").alias("listed"))
    sets = {
        "missing": (F.col("files") > 0) | (F.col("listed") == 0),
        "not listed": F.col("listed") == 1,
        "sole attempt": ((F.col("files") == 0) | ((F.col("files") == 1) & (F.col("first") == 1)), F.col("files")),
    }
    return gates.gather(gates.compiled(met, gate, _SOURCE, rules), gates.compiled(held, gate, _SOURCE, sets))


def completion_rules(completions: DataFrame, contracts: DataFrame, listed: DataFrame, endpoints: DataFrame, splits: dict[str, int] | None = None, gate: str = "completion") -> DataFrame:
    """Summaries (suite, cell, run_id, contract_sha256, cohort, phase, complete, four counts) against contract, list and endpoints."""
    fields = ["run_id", "contract_sha256", "cohort", "phase"]
    sizes = listed.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_sources"))
    met = completions.join(contracts.select(*_CELL, F.struct(*fields).alias("_contract")), _CELL, "left").join(sizes, _CELL, "left").na.fill(0, ["_sources"])
    counts = ["requested_sources", "completed_sources", "accepted_sources"]
    rules = {
        **{f: (F.col(f).eqNullSafe(F.col("_contract")[f]), F.col(f)) for f in fields},
        "complete": F.col("complete"),
        **{n: (F.col(n) == F.col("_sources"), F.col(n)) for n in counts},
        "exhausted_sources": (F.col("exhausted_sources") == 0, F.col("exhausted_sources")),
    }
    splits = MAIN_SPLITS if splits is None else splits
    main = contracts.where("phase = 'main'").select(*_CELL)
    found = endpoints.join(F.broadcast(main), _CELL, "left_semi").groupBy(*_CELL, "split_origin").agg(F.count(F.lit(1)).alias("n"))
    wanted = main.select(*_CELL, F.explode(F.map_from_arrays(F.array(*map(F.lit, splits)), F.array(*map(F.lit, splits.values())))).alias("split_origin", "many"))
    both = found.join(wanted, [*_CELL, "split_origin"], "full")
    share = {"splits": (F.coalesce("n", F.lit(0)) == F.coalesce("many", F.lit(0)), F.coalesce("n", F.lit(0)))}
    return gates.gather(gates.coverage(contracts, completions, gate, _CELL), gates.unique(completions, gate, _CELL), gates.compiled(met, gate, _CELL, rules), gates.compiled(both, gate, [*_CELL, "split_origin"], share))


def whole_cells(endpoints: DataFrame, contracts: DataFrame, wanted: DataFrame, listed: DataFrame, queue: DataFrame, completions: DataFrame, tokens: int, splits: dict[str, int] | None = None) -> DataFrame:
    """Every rule of complete result trees, for all cells at once."""
    return gates.gather(
        contract_rules(contracts, wanted),
        listed_rules(listed, contracts, queue),
        endpoint_rules(endpoints, contracts, queue, listed, tokens),
        completion_rules(completions, contracts, listed, endpoints, splits),
    )


def panel_rules(endpoints: DataFrame, contracts: DataFrame, cells: DataFrame, gate: str = "panel") -> DataFrame:
    """A panel of whole cells: just the wanted ones, one configuration, and the same sources, texts and splits in each.

    A source of the panel that a cell lacks is found by counting: a source has as many cells as there are, or its
    cells are taken from all. ``cells`` (suite, cell) is a short list that a configuration pins.
    """
    one = contracts.agg(*(F.count_distinct(c).alias(c) for c in ("run_id", "config_sha256")))
    many = {c: (F.col(c) <= 1, F.col(c)) for c in ("run_id", "config_sha256")}
    return gates.gather(gates.coverage(cells, contracts, f"{gate} contracts", _CELL), gates.compiled(one, f"{gate} contracts", ["run_id", "config_sha256"], many), gates.panel(endpoints, cells, gate))
