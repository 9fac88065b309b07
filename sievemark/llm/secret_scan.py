"""Secrets in texts, told apart by how many repositories and owners hold them; built-in functions only.

1. Each text is searched for three kinds of spans (``KINDS``) and for bare tokens that look random. A text is cut at
   the matches of a pattern; lengths of the cuts and matches, summed up, give places in code points. Matches of a kind
   don't overlap and are taken from the left; those that fail the kind's length are dropped afterwards.
2. Hashes of all values are counted over the whole corpus: equal (hash, owner, repository) first, then the
   repositories of an owner, then owners. So a value that a third of all texts hold is one row for each task.
3. A value of ``WIDE`` owners or more is an example that is copied widely. A value of one owner is that owner's own.
4. Bare tokens of one owner that no span of the three kinds touches are added as spans of kind ``owned``.

Null texts are empty; null owners and repositories count as one each. Repeated rows are rows of their own, told by a
number that is written with their spans. Windows and lists are of one text. The join of values with their counts may
be split by AQE. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

# fixed values: patterns, least lengths and names of the kinds, in their order
_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: Runs of these classes that are long enough: a run is matched from its start, so none is hidden by a shorter match.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "owned")

#: Bare tokens: runs of 20 characters or more with a digit, a letter and eight different characters at least.
BARE = "[A-Za-z0-9+/_=-]{20,}"
LEAST_DIFFERENT = 8
#: Owners from which on a value is an example.
WIDE = 3
_STEP = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sums_before(values: Column) -> Column:
    """For each of an array's numbers the sum of those before it, in blocks, as arrays grow by copying."""
    none = F.array().cast("array<long>")
    start = lambda at: F.struct(at.cast("long").alias("at"), none.alias("out"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)

    def summed(blocks: Column) -> Column:
        starts = F.aggregate(F.transform(blocks, total), start(F.lit(0)), step)["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda x, s: F.aggregate(x, start(s), step)["out"]))

    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int"))
    return F.when(F.size(values) > 0, _let(F.transform(numbers, lambda k: F.slice(values, k * _STEP + 1, F.lit(_STEP))), summed)).otherwise(none)


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """An array of (start, kind, end, value) of the matches whose value, the group, has ``least`` characters."""
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)

    def placed(found: Column) -> Column:
        parts = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x).cast("long"))
        spans = lambda lengths: _let(F.zip_with(lengths, found, lambda p, m: p + F.length(m)), lambda steps: F.zip_with(F.zip_with(sums_before(steps), lengths, lambda s, p: s + p), found, span))
        return F.filter(_let(parts, spans), lambda x: F.length(x["value"]) >= least)

    def span(start: Column, match: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("end"), value(match).alias("value"))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def looks_random(value: Column) -> Column:
    """Whether a token has a letter, a digit and enough different characters to be a credential."""
    return F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """row, doc_id, owner, repository and the spans of every text, values as hashes; written once, without texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    bare = F.filter(spans_of(F.col("text"), BARE, 3), lambda x: looks_random(x["value"]))
    found = F.concat(spans_of(F.col("text"), ASSIGN, 0, 2, ASSIGN_LEAST), spans_of(F.col("text"), ACCESS, 1), spans_of(F.col("text"), HEX, 2), bare)
    hashed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.unhex(F.sha2(x["value"], 256)).alias("hash")))
    return cut(rows.select("row", "doc_id", "owner", "repository", hashed.alias("found")))


def ownership(values: DataFrame) -> DataFrame:
    """hash, owners, repositories and occurrences of every value of (hash, owner, repository)."""
    held = values.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("occurrences"))
    of_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("occurrences").alias("occurrences"))
    return of_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("occurrences").alias("occurrences"))


def classified(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """row and spans (start, kind, end, class) of ``candidates``: class is example, shared or owned; free bare ones are kept only where owned."""
    each = found.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    label = F.when(F.col("owners") >= wide, "example").when(F.col("owners") == 1, "owned").otherwise("shared")
    told = each.select("row", "start", "kind", "end", "hash").join(ownership(each).select("hash", label.alias("class")), "hash").drop("hash")
    # the base span that ends last among those that start before a token, and the one that starts first after it
    base = F.col("kind") < 3
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumns({"last_end": F.max(F.when(base, F.col("end"))).over(before), "next_start": F.min(F.when(base, F.col("start"))).over(after)})
    free = (F.coalesce("last_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("next_start", F.col("end")) >= F.col("end"))
    return told.where(base | (free & (F.col("class") == "owned"))).select("row", "start", "kind", "end", "class")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(spark: SparkSession, docs: DataFrame, owner: str = "source", repository: str = "lang", wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and how spans are held.

    n_owned and n_example count the spans (the added ones too) whose value one owner has, and ``wide`` owners or more.
    """
    found = candidates(docs, owner, repository)
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    held = classified(found, wide).groupBy("row").agg(spans.alias("all"), F.count_if(F.col("class") == "owned").alias("n_owned"), F.count_if(F.col("class") == "example").alias("n_example"))
    base = F.filter("all", lambda x: x["kind"] < 3)
    out = found.select("row", "doc_id").join(held, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    of_kind = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [of_kind(k) for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
