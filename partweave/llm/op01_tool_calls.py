"""Chat formatting: tool-call linking.

An assistant message may be a JSON object with ``tool_calls``: a list of ``{"id", "name", "arguments"}``
(arguments an object, or a string holding one); a tool message is a JSON object with ``tool_call_id``.
Messages, calls and results become items, one row each.  Results and calls are hash-joined by
conversation and identifier; a call whose arguments hold ``{"$ref": id}`` depends on that call.  Items
are put in order by level: an item's level is one more than the highest level it depends on, found
without a limit on rounds; chains of calls with one reference each are followed by doubling steps, calls
with more are placed round by round.  So a conversation of any length is never gathered in one task.  ``order by
conv_id, level, turn, item`` is a topological order of a conversation; ``turn_level`` is the turn from which a result
has its call.  Arguments are checked against
a schema per tool and every item is written as canonical JSON (sorted keys, no white space, UTF-8).

Defined cases: a message that is no such JSON is a plain message; null role, text or turn stay null;
a call without a text as identifier is ``unlinked``; NaN and Infinity are no JSON; rows without conversation are one;
of calls with one identifier the first in (turn, item) is linked, the others are ``duplicate`` and their references do not count; a
result without a call is ``orphan``, a call without result ``open``; calls on a cycle of references,
or that depend on one, are ``cycle`` and keep level 0; equal messages stay apart; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep

ITEM = "conv_id long, turn long, item int, kind string, call_id string, refs array<string>, valid boolean, error string, json string"
TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: tool -> schema of its arguments: type, properties, required, enum, items
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def canonical(value) -> str:
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return text.encode("utf-8", "replace").decode()


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def _object(text) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        got = json.loads(text, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def check(value, schema: dict, at: str = "$") -> str | None:
    """The first violation of ``schema``, or None.  A reference stands for any value."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = number and (kind == "number" or isinstance(value, int) or value.is_integer()) if kind in ("number", "integer") else isinstance(value, TYPES.get(kind, object))
    if not fits:
        return f"{at}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not allowed"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            sub = schema.get("properties", {}).get(name)
            if sub is None and not schema.get("additionalProperties", True):
                return f"{at}.{name}: unknown"
            if sub and (e := check(value[name], sub, f"{at}.{name}")):
                return e
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            if e := check(x, schema["items"], f"{at}[{k}]"):
                return e
    return None


def references(value) -> set[str]:
    out, stack = set(), [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and isinstance(x["$ref"], str):
                out.add(x["$ref"])
            else:
                stack += x.values()
        elif isinstance(x, list):
            stack += x
    return out


def items(role, text, schemas: dict) -> Iterator[tuple]:
    """(item, kind, call_id, refs, valid, error, json) of one message."""
    got = _object(text) if role in ("assistant", "tool") else None
    calls = got.get("tool_calls") if got and role == "assistant" else None
    if not (isinstance(calls, list) and calls and all(isinstance(c, dict) for c in calls)):
        calls = None
    if got and role == "tool" and isinstance(got.get("tool_call_id"), str):
        yield 0, "result", got["tool_call_id"], [], None, None, canonical({"role": "tool", **got})
        return
    if calls is None:
        yield 0, "message", None, [], None, None, canonical({"role": role, "content": text})
        return
    yield 0, "message", None, [], None, None, canonical({"role": role, **{k: v for k, v in got.items() if k != "tool_calls"}})
    for k, call in enumerate(calls, 1):
        args, name = call.get("arguments"), call.get("name")
        if isinstance(args, str):
            args = _object(args)
        if not isinstance(args, dict):
            error = "$: not object"
        elif not isinstance(name, str) or name not in schemas:
            error = "unknown tool"
        else:
            error = check(args, schemas[name])
        own = call.get("id") if isinstance(call.get("id"), str) else None
        if own is None:
            error = "$.id: not string"
        body = {"type": "function", "id": call.get("id"), "name": name, "arguments": args if isinstance(args, dict) else call.get("arguments")}
        yield k, "call", own, sorted(references(args)), error is None, error, canonical(body)


def link_tool_calls(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per item, with ``state``, ``level`` and ``turn_level``."""
    scratch = Scratch(turns.sparkSession)
    schemas = SCHEMAS if schemas is None else schemas

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEM.split(", ")]
        for pdf in batches:
            rows = [(c, t, *x) for c, t, r, s in zip(pdf["conv_id"], pdf["turn"].astype("Int64"), pdf["role"], pdf["text"], strict=True) for x in items(r, s, schemas)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"turn": "Int64", "valid": "boolean"})

    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))  # joins by it must find null too
    rows = scratch.table(turns.mapInPandas(parse, ITEM.replace("conv_id long", "conv_id string")), "items")
    calls = rows.where("kind = 'call' AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "item", "json", "refs")).alias("first"))
    calls = scratch.table(calls.select("conv_id", "call_id", F.struct("first.turn", "first.item", "first.json").alias("first"), F.col("first.refs").alias("refs")), "calls")
    edges = scratch.table(calls.select("conv_id", "call_id", F.explode("refs").alias("on")).join(calls.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]), "edges")
    n_refs = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
    placed = calls.join(n_refs, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).cast("long").alias("depth"))
    placed = scratch.table(placed, "placed0")
    if not edges.isEmpty():
        # a call with one reference points ``w`` steps down its chain; each step doubles that, so only chains into a cycle still move in the end
        jump = edges.join(n_refs.where("n = 1"), ["conv_id", "call_id"], "left_semi").select("conv_id", "call_id", F.col("on").alias("to"), F.lit(1).cast("long").alias("w"))
        jump, reach, total = scratch.table(jump, "jump0"), 1, calls.count()
        while reach <= total:
            ahead = jump.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"))
            moved = jump.join(ahead, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("next", "to").alias("to"), F.expr("w + coalesce(more, 0)").alias("w"), F.col("next").isNotNull().alias("moved"))
            reach *= 2
            moved = scratch.table(moved, f"jump{reach}")
            jump = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        # calls with more references are placed when all of them are; each round writes only the calls it places
        many = edges.join(n_refs.where("n > 1"), ["conv_id", "call_id"], "left_semi").join(jump.select("conv_id", F.col("call_id").alias("on"), "to", "w"), ["conv_id", "on"], "left")
        many = scratch.table(many.select("conv_id", "call_id", F.coalesce("to", "on").alias("to"), F.expr("1 + coalesce(w, 0)").alias("w")), "many")
        paths, now = [f"{scratch.base}/placed0"], not many.isEmpty()
        while now:
            left = many.join(placed.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(placed.withColumnRenamed("call_id", "to"), ["conv_id", "to"], "left")
            new = left.groupBy("conv_id", "call_id").agg(F.max(F.expr("depth + w")).alias("depth"), F.count_if(F.col("depth").isNull()).alias("missing")).where("missing = 0").drop("missing")
            paths.append(f"{scratch.base}/placed{len(paths)}")
            now = not scratch.table(new, paths[-1].rsplit("/", 1)[1]).isEmpty()
            placed = scratch.spark.read.schema(placed.schema).parquet(*paths)
        placed = placed.union(jump.join(placed.withColumnRenamed("call_id", "to"), ["conv_id", "to"]).select("conv_id", "call_id", F.expr("depth + w")))
    placed = placed.select("conv_id", "call_id", F.col("depth").cast("int").alias("depth"))
    answered = rows.where("kind = 'result'").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    facts = calls.select("conv_id", "call_id", "first").join(placed, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    linked = rows.where("call_id IS NOT NULL").join(facts, ["conv_id", "call_id"], "left")
    state = F.expr("""CASE WHEN kind = 'result' THEN CASE WHEN first IS NULL THEN 'orphan' ELSE 'linked' END
        WHEN struct(turn, item, json) <> first THEN 'duplicate' WHEN depth IS NULL THEN 'cycle' WHEN answered THEN 'linked' ELSE 'open' END""")
    level = F.expr("CASE WHEN depth IS NULL THEN 0 ELSE 2 * depth + 1 + cast(kind = 'result' AS int) END")
    linked = linked.select(*rows.columns, state.alias("state"), level.alias("level"), F.when((F.col("kind") == "result") & F.col("first").isNotNull(), F.greatest("turn", "first.turn")).otherwise(F.col("turn")).alias("turn_level"))
    plain = rows.where("call_id IS NULL").select(*rows.columns, F.when(F.col("kind") == "call", "unlinked").otherwise("plain").alias("state"), F.lit(0).alias("level"), F.col("turn").alias("turn_level"))
    out = plain.union(linked).drop("refs")
    return keep(out.withColumn("conv_id", F.col("conv_id").try_cast("long")), scratch)
