"""Tool-call linking: calls and results joined by identifier, ordered topologically, validated and serialised.

``link_calls`` takes calls (conv_id, call_id, turn, name, arguments, refs, maybe after) and results (conv_id, call_id, turn,
content), where ``arguments`` is JSON text and ``refs`` names calls whose results the call uses.

* Link: one row for each (conv_id, call_id); of repeated calls or results the one of the smallest turn, then text,
  counts. Results meet calls in a hash join on both columns; results without a call stay as orphans.
* Order: level 0 has the calls without references, level n those whose references are all below n and one at
  n - 1. Chains of calls with one reference each are shortened by half in every round, so their rounds grow with the
  logarithm of their length; then come rounds over the calls with several references, as many as follow each other on
  the deepest path. Calls on or behind a cycle get no level. ``place`` numbers a conversation's calls from 0 by level,
  turn and call_id. It comes from three levels of running counts, so a conversation that holds a third of all rows
  isn't sorted in one task.
* Validate: ``arguments`` against the schema of the call's name (a subset of JSON Schema, see ``problems_of``).
* Serialise: one line of canonical JSON for each row: sorted keys, no spaces, UTF-8 as it is.

Rows, not whole conversations, are serialised: a conversation has no bound, a call has.

Status: ``orphan`` (a result without a call), ``cyclic``, ``invalid`` (see ``problems``), ``unanswered``, ``ok``.
A null conv_id or call_id can't be linked and gets status ``unlinked``. Null arguments are invalid. References to unknown
calls are problems and don't order. Arguments that aren't JSON, or that JSON can't write again (1e999, a lone
surrogate), are ``invalid`` with the problem ``$: not JSON`` and null in the line. An empty table gives an empty result. Other columns are ignored.

``whole`` adds rows for what linking leaves over, so that nothing of the input is missing: status ``duplicate`` for each
text that repeats a call or result (``copies`` says how often, the kept one not counted; 1 in all other rows) and, in
``format_turns``, status ``message`` for each turn that is no call or result (of a system, say, or without a role) or
says more than its calls or result hold, with its role and whole text in the line.

``plain_calls`` reads a table of turns (conv_id, turn, role, text). A turn whose text is a JSON object with
``tool_calls`` (or ``tool_call_id``) gives those calls (that result). Other turns are read as the simplest
exchange: a user's turn calls ``respond`` with its text, and the assistant's turn after it is the result. Such a call
comes after the one two turns before it, if there is one: calls may name a call in ``after``, which orders them as a
reference does but is no problem where it isn't known.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, written

#: Turns whose calls are numbered together.
CHUNK_TURNS = 256
#: Brackets from which a value is written on trial, as it may be nested too deeply to be written.
DEEP = 200
RESPOND = {"respond": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}
_CALLS = "conv_id long, call_id string, turn long, name string, arguments string, refs array<string>, after string, content string, is_call boolean"
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, without spaces, UTF-8 as it is; numbers that JSON doesn't have are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, int | float))
    return isinstance(value, _TYPES[kind])


def problems_of(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` breaks of ``schema``: type, enum, const, lengths, bounds, properties and items."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: enum")
    if "const" in schema and value != schema["const"]:
        found.append(f"{at}: const")
    size = len(value) if isinstance(value, str | list) else None
    if size is not None:
        least, most = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if size < schema.get(least, 0):
            found.append(f"{at}: {least}")
        if size > schema.get(most, size):
            found.append(f"{at}: {most}")
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            found.append(f"{at}: minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: maximum")
    if isinstance(value, list) and "items" in schema:
        found += [p for k, x in enumerate(value) for p in problems_of(x, schema["items"], f"{at}[{k}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: required" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems_of(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    return found


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _finite(number: str) -> float:
    value = float(number)
    if math.isinf(value):
        raise ValueError(number)
    return value


def parsed(arguments: str | None) -> tuple[Any, bool]:
    """The value of a JSON text, and whether it is one.

    Texts that can't be written again as canonical UTF-8 JSON aren't taken as JSON: numbers beyond doubles (1e999),
    lone surrogates (\\ud800), NaN, and values nested too deeply.
    """
    try:
        value = json.loads(arguments, parse_constant=_refuse, parse_float=_finite)
        if "\\u" in arguments or arguments.count("[") + arguments.count("{") >= DEEP:
            canonical(value).encode()
        return value, True
    except (TypeError, ValueError, RecursionError):
        return None, False


def _messages(role: str | None, conv: int | None, turn: int | None, text: str | None) -> list[tuple]:
    """Calls and results of one turn; a message, with null for ``is_call``, if they don't hold all that it says."""
    message = (conv, None, turn, None, None, [], None, canonical({"content": text, "role": role}), None)
    value = parsed(text)[0] if text and text.lstrip()[:1] == "{" else None
    if isinstance(value, dict) and isinstance(value.get("tool_calls"), list):
        out = []
        whole = set(value) == {"tool_calls"} and value["tool_calls"] != []
        for x in value["tool_calls"]:
            own = x if isinstance(x, dict) else {}
            refs = own.get("refs")
            arguments = own.get("arguments")
            arguments = arguments if isinstance(arguments, str) else canonical(arguments) if arguments is not None else None
            out.append((conv, _text(own.get("id")), turn, _text(own.get("name")), arguments, [str(r) for r in refs] if isinstance(refs, list) else [], None, None, True))
            whole = whole and own is x and set(x) <= {"id", "name", "arguments", "refs"} and (refs is None or isinstance(refs, list)) and (arguments is None or parsed(arguments)[1])
        return out if whole else [*out, message]
    if isinstance(value, dict) and "tool_call_id" in value:
        content = value.get("content")
        result = (conv, _text(value["tool_call_id"]), turn, None, None, [], None, content if isinstance(content, str) or content is None else canonical(content), False)
        return [result] if set(value) <= {"tool_call_id", "content"} else [result, message]
    known = conv is not None and turn is not None
    if role == "user":
        after = f"{conv}:{turn - 2}" if known else None
        return [(conv, f"{conv}:{turn}" if known else None, turn, "respond", canonical({"text": text}), [], after, None, True)]
    if role == "assistant":
        return [(conv, f"{conv}:{turn - 1}" if known else None, turn, None, None, [], None, text, False)]
    return [message]


def _text(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else canonical(value)


def plain_calls(turns: DataFrame) -> DataFrame:
    """Calls, results (``is_call``) and messages (null) of a table of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_())
        names = ["conv_id", "call_id", "turn", "name", "arguments", "refs", "after", "content", "is_call"]
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("role", "conv_id", "turn", "text")), strict=True)
            found = [x for row in rows for x in _messages(*row)]
            columns = list(zip(*found, strict=True)) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return turns.selectExpr("role", "CAST(conv_id AS long) conv_id", "CAST(turn AS long) turn", "text").mapInArrow(run, _CALLS)


def _anchors(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, far) of calls with one reference: the first call behind it that has none or several.

    ``far`` is the number of references between. Pointers to pointers are followed at once, so a chain of n calls takes
    about log2(n) rounds; chains that are still open then run in circles, and are left out.
    """
    key = ["conv_id", "call_id"]
    single = edges.groupBy(*key).agg(F.min("ref").alias("anchor"), F.count(F.lit(1)).alias("refs")).where("refs = 1").drop("refs")
    single = written(single)
    open_ = single.select("conv_id", F.col("call_id").alias("anchor"), F.lit(True).alias("more"))
    pointers = written(single.join(open_, ["conv_id", "anchor"], "left").select(*key, "anchor", F.lit(1).alias("far"), F.coalesce("more", F.lit(False)).alias("more")))
    for _ in range(pointers.count().bit_length()):
        left = pointers.where("more")
        if left.isEmpty():
            break
        ahead = pointers.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("to"), F.col("far").alias("further"), F.col("more").alias("still"))
        left = left.join(ahead, ["conv_id", "anchor"]).select(*key, F.col("to").alias("anchor"), (F.col("far") + F.col("further")).alias("far"), F.col("still").alias("more"))
        pointers = written(pointers.where("NOT more").union(left))
    return pointers.where("NOT more").drop("more")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that no cycle holds back."""
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode(F.array_distinct(F.concat("refs", F.array("after")))).alias("ref"))
    known = calls.select("conv_id", F.col("call_id").alias("ref"))
    edges = written(edges.join(known, ["conv_id", "ref"], "left_semi"))
    anchors = _anchors(edges)
    done = calls.select(*key).join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0))

    # calls with several references, whose chains in between are now single edges
    several = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("refs")).where("refs > 1").drop("refs")
    single = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("refs")).where("refs = 1").select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("chained"))
    ends = anchors.select("conv_id", F.col("call_id").alias("ref"), "anchor", "far")
    joined = edges.join(several, key).join(single, ["conv_id", "ref"], "left").join(ends, ["conv_id", "ref"], "left")
    # behind a circle there is no anchor, and such an edge is never settled
    anchor = F.when(F.col("chained"), F.col("anchor")).otherwise(F.col("ref"))
    left = written(joined.select(*key, anchor.alias("anchor"), F.coalesce("far", F.lit(0)).alias("far")))
    while not left.isEmpty():
        level = left.join(done.select("conv_id", F.col("call_id").alias("anchor"), "level"), ["conv_id", "anchor"], "left")
        ready = level.groupBy(*key).agg(F.max(F.col("level") + F.col("far") + 1).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("ready"))
        ready = written(ready.where("ready").drop("ready"))
        if ready.isEmpty():
            break
        done = written(done.union(ready))
        left = written(left.join(ready, key, "left_anti"))
    ends = done.select("conv_id", F.col("call_id").alias("anchor"), "level")
    return done.union(anchors.join(ends, ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("far")).alias("level")))


def _places(ordered: DataFrame) -> DataFrame:
    """``place`` by level, turn and call_id in each conversation: in chunks, over the chunks of a band of levels, over bands."""
    chunk = F.struct("level", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK_TURNS).alias("part"))
    df = ordered.withColumn("_chunk", chunk)
    own = Window.partitionBy("conv_id", "_chunk").orderBy(F.col("turn").asc_nulls_first(), "call_id")
    df = df.withColumn("_nth", F.row_number().over(own) - 1)
    band = F.floor(F.col("_chunk.level") / CHUNK_TURNS).alias("_band")
    sizes = cut(ordered.groupBy("conv_id", chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))).select("*", band)
    so_far = lambda by, at: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = sizes.groupBy("conv_id", "_band").agg(F.sum("_n").alias("_n"))
    bands = bands.select("conv_id", "_band", so_far(["conv_id"], "_band").alias("_low"))
    sizes = sizes.withColumn("_before", so_far(["conv_id", "_band"], "_chunk")).join(bands, ["conv_id", "_band"])
    sizes = sizes.select("conv_id", "_chunk", (F.col("_before") + F.col("_low")).alias("_before"))
    return df.join(sizes, ["conv_id", "_chunk"]).withColumn("place", F.col("_before") + F.col("_nth")).drop("_chunk", "_nth", "_before")


def _serialise(batch: pa.RecordBatch, schemas: dict[str, dict]) -> pa.RecordBatch:
    out: list[tuple] = []
    fields = ("call_id", "name", "arguments", "unknown", "content", "is_call", "answered", "level", "repeated")
    for call, name, arguments, unknown, content, is_call, answered, level, repeated in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
        problems: list[str] = []
        value = None
        if is_call:
            value, good = parsed(arguments)
            if not good:
                problems = ["$: not JSON"]
            elif name not in schemas:
                problems = ["name: unknown"]
            else:
                problems = problems_of(value, schemas[name])
            problems += [f"refs: {x}" for x in sorted(unknown or [])]
        if call is None or batch.column("conv_id")[len(out)].as_py() is None:
            status = "unlinked"
        elif repeated:
            status = "duplicate"
        elif not is_call:
            status = "orphan"
        elif level is None:
            status = "cyclic"
        elif problems:
            status = "invalid"
        else:
            status = "ok" if answered else "unanswered"
        out.append((status, problems, canonical({"arguments": value, "id": call, "name": name, "result": content})))
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    types = (pa.string(), pa.list_(pa.string()), pa.string())
    kept = ["conv_id", "call_id", "turn", "level", "place"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), batch.column("copies")], names=[*kept, "status", "problems", "line", "copies"])


def _repeats(items: DataFrame, kept: DataFrame, body: list[str]) -> DataFrame:
    """conv_id, call_id, ``body`` and copies of the items beside the kept one of their key; ``kept`` has it as ``c``, and its items as ``n``."""
    key = ["conv_id", "call_id"]
    counted = items.join(kept.where("n > 1").select(*key, "c"), key).groupBy(*key, "c", *body).agg(F.count(F.lit(1)).alias("copies"))
    return counted.withColumn("copies", F.col("copies") - F.struct(*body).eqNullSafe(F.col("c")).cast("long")).where("copies > 0").drop("c")


def link_calls(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: dict[str, dict], whole: bool = False) -> DataFrame:
    """One row per call, orphan result and unlinkable row: conv_id, call_id, turn, level, place, status, problems, line, copies.

    ``whole``: and one per text that repeats a call or result.
    """
    key = ["conv_id", "call_id"]
    body = ["turn", "name", "arguments", "refs", "after"]
    linked = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    after = F.col("after") if "after" in calls.columns else F.lit(None).cast("string")
    calls = calls.withColumns({"refs": F.coalesce("refs", F.array().cast("array<string>")), "after": after})
    first = cut(calls.where(linked).groupBy(*key).agg(F.min(F.struct(*body)).alias("c"), F.count(F.lit(1)).alias("n")))
    own = first.select(*key, *(F.col(f"c.{x}").alias(x) for x in body))
    answers = results.where(linked).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n"))
    known = own.select("conv_id", F.col("call_id").alias("ref"))
    unknown = own.select(*key, F.explode(F.array_distinct("refs")).alias("ref")).join(known, ["conv_id", "ref"], "left_anti").groupBy(*key).agg(F.collect_set("ref").alias("unknown"))
    placed = _places(own.select(*key, "turn").join(levels(own), key)).select(*key, "level", "place")
    joined = own.join(answers, key, "left").join(placed, key, "left").join(unknown, key, "left")
    columns = [*key, "turn", "name", "arguments", "unknown", "content", "is_call", "answered", "level", "place"]
    yes, no, none = F.lit(True), F.lit(False), F.lit(None)
    rows = joined.select(*key, "turn", "name", "arguments", "unknown", F.col("r.content").alias("content"), yes.alias("is_call"), F.col("r").isNotNull().alias("answered"), "level", "place")
    blank = {"unknown": none.cast("array<string>"), "level": none.cast("int"), "place": none.cast("long")}
    orphans = answers.join(own.select(*key), key, "left_anti").select(*key, F.col("r.turn").alias("turn"), F.col("r.content").alias("content"))
    orphans = orphans.withColumns(blank | {"name": none.cast("string"), "arguments": none.cast("string"), "is_call": no, "answered": no})
    stray = calls.where(~linked).select(*key, "turn", "name", "arguments").withColumns(blank | {"content": none.cast("string"), "is_call": yes, "answered": no})
    lost = results.where(~linked).select(*key, "turn", "content").withColumns(blank | {"name": none.cast("string"), "arguments": none.cast("string"), "is_call": no, "answered": no})
    for more in (orphans, stray, lost):
        rows = rows.unionByName(more.select(*columns))
    rows = rows.withColumns({"repeated": no, "copies": F.lit(1).cast("long")})
    if whole:
        again = _repeats(calls.where(linked), first, body).drop("refs", "after").withColumns(blank | {"content": none.cast("string"), "is_call": yes, "answered": no})
        echoes = _repeats(results.where(linked), answers.withColumnRenamed("r", "c"), ["turn", "content"])
        echoes = echoes.withColumns(blank | {"name": none.cast("string"), "arguments": none.cast("string"), "is_call": no, "answered": no})
        for more in (again, echoes):
            rows = rows.unionByName(more.withColumn("repeated", yes).select(*columns, "repeated", "copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _serialise(batch, schemas)

    return rows.mapInArrow(run, "conv_id long, call_id string, turn long, level int, place long, status string, problems array<string>, line string, copies long")


def format_turns(spark: SparkSession, turns: DataFrame, schemas: dict[str, dict] | None = None, whole: bool = False) -> DataFrame:
    """``link_calls`` over a table of turns; ``whole``: with the messages."""
    messages = plain_calls(turns)
    rows = link_calls(spark, messages.where("is_call"), messages.where("NOT is_call"), RESPOND if schemas is None else schemas, whole)
    if not whole:
        return rows
    plain = messages.where("is_call IS NULL")
    return rows.unionByName(plain.selectExpr("conv_id", "call_id", "turn", "CAST(NULL AS int) level", "CAST(NULL AS long) place", "'message' status", "CAST(array() AS array<string>) problems", "content line", "1L copies"))
