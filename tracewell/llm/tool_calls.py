"""Chat formatting of tool calls: link results to calls, order calls by what they need, check arguments, write canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import materialise

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """What in ``value`` breaks a JSON schema: type, enum, required, properties, additionalProperties, items and bounds."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_a = lambda kind: isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value)) if kind in ("number", "integer") else isinstance(value, _TYPES[kind])
    if kinds and not any(is_a(k) for k in kinds):
        return [f"{path}: not of type {'|'.join(kinds)}"]
    found = [f"{path}: not one of the values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                found += schema_errors(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        found += [e for k, v in enumerate(value) for e in schema_errors(v, schema["items"], f"{path}[{k}]")]
    elif isinstance(value, str):
        found += [f"{path}: shorter than {schema['minLength']}"] if len(value) < schema.get("minLength", 0) else []
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{path}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        found += [f"{path}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    return found


def canonical(value) -> str:
    """JSON with sorted keys, no white space, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _chains(calls: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(call_id, up, dist, ended) of calls with one need, and the other calls (call_id, several).

    ``up`` is the first call up the chain that hasn't just one need, ``dist`` steps away. Pointers are doubled in each round, so
    there are as many rounds as the longest chain has binary digits; chains that end in a cycle are not ``ended``.
    """
    counts = needs.groupBy("call_id").count()
    tops = materialise(calls.join(counts, "call_id", "left").where("count is null or count > 1").select("call_id", F.col("count").isNotNull().alias("several")), "tops")
    one = needs.join(counts.where("count = 1").select("call_id"), "call_id").withColumnRenamed("needed", "up")
    ends = tops.select(F.col("call_id").alias("up"), F.lit(True).alias("end"))
    steps = materialise(one.join(ends, "up", "left").select("call_id", "up", F.lit(1).alias("dist"), F.coalesce("end", F.lit(False)).alias("ended")), "steps")
    for _ in range(steps.count().bit_length() + 1):
        if not steps.where("not ended").take(1):
            break
        next_up = steps.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("ended").alias("ended2"))
        moved = steps.where("not ended").join(next_up, "up").select("call_id", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("ended2").alias("ended"))
        steps = materialise(steps.where("ended").unionByName(moved), "steps")
    return steps, tops


def topological_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """call_id, level for ``calls`` (call_id) under ``needs`` (call_id, needed): 0 without needs, else one above the highest need.

    Calls on a cycle, or that need one, get no row. Needs of unknown calls are ignored. Chains of calls with one need are
    shortened by pointer doubling; calls with several needs are settled by rounds of joins over what is left, one for each of
    them on the longest path. Every round ends in a table in the shared folder.
    """
    needs = materialise(needs.join(calls.withColumnRenamed("call_id", "needed"), "needed", "left_semi").join(calls, "call_id", "left_semi").distinct(), "needs")
    steps, tops = _chains(calls, needs)
    new = tops.where("not several").select(F.col("call_id").alias("up"), F.lit(0).alias("level"))
    settled = [new]
    open_ = tops.where("several").select("call_id")
    if open_.take(1):
        above = steps.select(F.col("call_id").alias("needed"), "up", "dist")
        left = needs.join(open_, "call_id").join(above, "needed", "left").select("call_id", F.coalesce("up", "needed").alias("up"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
        left, reached = materialise(left, "left"), None
        while new.take(1) and left.take(1):
            found = left.join(new, "up").groupBy("call_id").agg(F.max(F.col("level") + F.col("dist")).alias("level"))
            reached = materialise(found if reached is None else reached.unionByName(found).groupBy("call_id").agg(F.max("level").alias("level")), "reached")
            left = materialise(left.join(new, "up", "left_anti").select("call_id", "up", "dist"), "left")
            ready = reached.join(left.select("call_id"), "call_id", "left_anti")
            new = materialise(ready.select(F.col("call_id").alias("up"), "level"), "level")
            settled.append(new)
            reached = reached.join(new.select(F.col("up").alias("call_id")), "call_id", "left_anti")
    levels = settled[0]
    for part in settled[1:]:
        levels = levels.unionByName(part)
    below = steps.where("ended").join(levels, "up").select("call_id", (F.col("level") + F.col("dist")).cast("int").alias("level"))
    return levels.select(F.col("up").alias("call_id"), F.col("level").cast("int").alias("level")).unionByName(below)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, level, status, errors, result_turn, canonical.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call ids). ``results``: call_id, turn,
    content. Calls and results are joined by identifier; sorting by conv_id, level, turn, call_id puts each call after what it
    needs. status is ``ok``; ``cycle`` (level null) if the call needs itself, however indirectly; ``unlinked`` without a result;
    ``invalid`` if arguments are no JSON, break the schema, or the name has none; the first of these that applies. errors lists
    what the arguments break. ``canonical`` is the call with arguments and result as JSON with sorted keys.

    Repeated identifiers: the call of the least (conv_id, turn, arguments) counts, and the result of the least (turn, content);
    so repeated rows give one row. Calls without identifier are left out, results without call too. Null arguments are invalid,
    a null result is null in the JSON, null needs are none. Empty tables: no calls, no rows. Extra columns are ignored.
    """
    first = lambda df, *cols: df.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(*cols)).alias("r")).select("call_id", "r.*")
    calls = materialise(first(calls, "conv_id", "turn", "arguments", "name", F.coalesce("needs", F.array().cast("array<string>")).alias("needs")), "calls")
    answers = first(results, F.col("turn").alias("result_turn"), "content")
    levels = topological_levels(calls.select("call_id"), calls.select("call_id", F.explode("needs").alias("needed")))
    linked = calls.join(levels, "call_id", "left").join(answers.withColumn("linked", F.lit(True)), "call_id", "left")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    value = json.loads(r["arguments"] or "")
                    errors = schema_errors(value, schemas[r["name"]]) if r["name"] in schemas else ["$: no schema"]
                except ValueError:
                    value, errors = r["arguments"], ["$: not JSON"]
                status = "cycle" if r["level"] is None else "unlinked" if not r["linked"] else "invalid" if errors else "ok"
                text = canonical({"arguments": value, "id": r["call_id"], "name": r["name"], "result": r["content"]})
                rows.append((r["conv_id"], r["turn"], r["call_id"], r["name"], r["level"], status, errors, r["result_turn"], text))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "call_id", "name", "level", "status", "errors", "result_turn", "canonical"])

    return linked.select("conv_id", "turn", "call_id", "name", "arguments", "level", "result_turn", "content", "linked").mapInArrow(
        check, "conv_id long, turn long, call_id string, name string, level int, status string, errors array<string>, result_turn long, canonical string"
    )


#: The tools that conversations are taken to call: the turn's text goes to one of them.
TOOLS = {
    "lookup": {"type": "object", "required": ["query", "turn"], "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False},
    "summarise": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0, "maximum": 5}}, "additionalProperties": False},
}


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results, derived from turns: a user's turn calls a tool, the assistant's next turn is its result.

    The identifier is conversation and turn. A user's turn of over 200 characters is summarised, others are looked up; it needs
    the call of the user's turn before, two turns earlier. Null ids or turns give calls without identifier.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)
    long_text = F.length("text") > 200
    arguments = F.when(long_text, F.to_json(F.struct("turn", "text"))).otherwise(F.to_json(F.struct("turn", F.col("text").alias("query"))))
    calls = turns.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(long_text, "summarise").otherwise("lookup").alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("needs"))
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
