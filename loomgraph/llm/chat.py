"""Chat formatting: tool calls and their results, linked, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by identifier.  Calls are ordered topologically: a call's level is one more than the
highest level of the calls that it depends on, found by doubling pointers, all conversations at once.  Arguments are
validated against the schema of their tool, and every linked call becomes one line of canonical JSON (keys sorted, no
blanks, no escapes but those that JSON demands).

Cases: a call without a result has a null result, and so has its JSON; of several results of one identifier the one with
the least turn counts (then the least content); of repeated calls of one identifier the first, alike, and a result without a
call is left out; a call without an identifier can't be linked and is left out as well; a dependency on a call that is not there is reported and otherwise ignored; calls on or behind a cycle
have no level and say so; null or malformed arguments are reported; a tool without a schema is reported.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, shipped

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What about a value breaks a schema of type, enum, required, properties, additionalProperties, items and bounds."""
    found: list[str] = []
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            found.append(f"{at}: too large")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not known")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    return found


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) for every call that no cycle holds back; calls: call_id and depends_on.

    A call with one dependency points to it, and pointers double in each round until they reach a call with none or several, so
    a chain takes as many rounds as its length has binary digits. What is left are the calls with several dependencies:
    they are placed in rounds, as many as such calls stand behind each other."""
    ids = calls.select("call_id").distinct()
    links = checkpointed(calls.select("call_id", F.explode("depends_on").alias("dep")).distinct().join(ids.select(F.col("call_id").alias("dep")), "dep"))  # to calls that exist
    count = links.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("up"))
    state = checkpointed(
        ids.join(count, "call_id", "left").select("call_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("up")).otherwise(F.col("call_id")).alias("up"), F.when(F.col("n") == 1, 1).otherwise(0).alias("dist"), (F.coalesce("n", F.lit(0)) != 1).alias("done"))
    )
    open_now = state.where("not done").count()
    while open_now:
        ahead = state.select(F.col("call_id").alias("at"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("done").alias("there"))
        moved = state.where("not done").join(ahead, F.col("up") == F.col("at")).select("call_id", "n", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("there").alias("done"))
        state = checkpointed(state.where("done").unionByName(moved))
        left = state.where("not done").count()
        if left == open_now:  # each round places some call unless all that is left hangs on a cycle
            break
        open_now = left
    place = state.where("done").select("call_id", F.col("up").alias("anchor"), "dist")
    known = state.where("n = 0").select("call_id", F.lit(0).alias("level"))
    joints = state.where("n > 1").select("call_id")
    if not joints.isEmpty():
        steps = checkpointed(
            links.join(joints, "call_id", "left_semi").join(place.select(F.col("call_id").alias("dep"), "anchor", "dist"), "dep", "left").select("call_id", "anchor", (F.col("dist") + 1).alias("d"))
        )
        while True:
            reach = steps.join(known.select(F.col("call_id").alias("anchor"), "level"), "anchor", "left")
            ready = reach.groupBy("call_id").agg(F.max(F.col("level") + F.col("d")).alias("level"), F.count("level").alias("has"), F.count(F.lit(1)).alias("of")).where("has = of").select("call_id", "level")
            new = checkpointed(ready.join(known, "call_id", "left_anti"))
            if new.isEmpty():
                break
            known = checkpointed(known.unionByName(new))
    return place.join(known.select(F.col("call_id").alias("anchor"), "level"), "anchor").select("call_id", (F.col("level") + F.col("dist")).cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call_id); results: turn, call_id, content.
    For each call, by identifier: conv_id, turn, call_id, name, level, result_turn, valid, errors (array) and json.
    A call or result without an identifier links to nothing and is left out; of several calls (results) of one identifier the first counts."""
    first = lambda df, cols: df.groupBy("call_id").agg(F.min(F.struct(*cols)).alias("s")).select("call_id", "s.*")
    one = first(calls.where("call_id is not null"), ["conv_id", "turn", "name", "arguments", "depends_on"])
    answer = first(results.where("call_id is not null"), ["turn", "content"]).select("call_id", F.col("turn").alias("result_turn"), F.col("content").alias("result"))
    one = checkpointed(one)
    missing = (
        one.select("call_id", F.explode("depends_on").alias("dep"))
        .join(one.select(F.col("call_id").alias("dep")), "dep", "left_anti")
        .groupBy("call_id")
        .agg(F.array_sort(F.collect_set("dep")).alias("missing"))  # of one call
    )
    whole = one.join(levels(one), "call_id", "left").join(missing, "call_id", "left").join(answer, "call_id", "left")
    tools_of = shipped(calls.sparkSession, schemas)  # the tools' definitions
    kinds = dict(calls.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, call_id string, name string, level int, result_turn {dict(results.dtypes)['turn']}, valid boolean, errors array<string>, json string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tools_of()
        for b in batches:
            valid, errors, texts = [], [], []
            for r in b.select(["call_id", "name", "arguments", "level", "missing", "result"]).to_pylist():
                bad: list[str] = []
                value = None
                try:
                    value = json.loads(r["arguments"]) if r["arguments"] is not None else None
                except ValueError:
                    bad.append("$: no JSON")
                if r["arguments"] is None:
                    bad.append("$: no arguments")
                elif r["name"] not in tools:
                    bad.append("no such tool")
                elif not bad:
                    bad += violations(value, tools[r["name"]])
                if r["level"] is None:
                    bad.append("held back by a cycle")
                bad += [f"depends on {x}, which is not there" for x in r["missing"] or ()]
                valid.append(not bad)
                errors.append(bad)
                texts.append(canonical_json({"arguments": value, "id": r["call_id"], "name": r["name"], "result": r["result"]}))
            new = {"valid": pa.array(valid, pa.bool_()), "errors": pa.array(errors, pa.list_(pa.string())), "json": pa.array(texts, pa.string())}
            names = ["conv_id", "turn", "call_id", "name", "level", "result_turn", "valid", "errors", "json"]
            yield pa.RecordBatch.from_arrays([new[k] if k in new else b.column(b.schema.get_field_index(k)) for k in names], names=names)

    return whole.mapInArrow(run, schema)


#: The tool that turns of plain conversations are taken to call, and its schema.
REPLY = "reply"
REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "words"],
    "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 3}},
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls ``reply``, the assistant's turn behind it is the result,
    and a call depends on the one two turns before, where that is the user's too. Rows without conversation or turn take no part."""
    rows = conversations.where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != ""))
    user = rows.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), text.alias("t"), words.alias("w"))
    earlier = user.select(name(F.col("turn") + 2).alias("call_id"), F.col("call_id").alias("dep")).distinct()
    calls = user.join(earlier, "call_id", "left").select(
        "conv_id",
        "turn",
        "call_id",
        F.lit(REPLY).alias("name"),
        F.to_json(F.struct(F.col("t").alias("prompt"), F.col("w").alias("words"))).alias("arguments"),
        F.when(F.col("dep").isNull(), F.array().cast("array<string>")).otherwise(F.array("dep")).alias("depends_on"),
    )
    return calls, rows.where("role = 'assistant'").select("turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
