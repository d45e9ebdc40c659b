"""Taint across functions and files: facts from syntax trees, joined to a fixpoint on the call graph."""

from __future__ import annotations

import ast
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tracewell.operators.cut import cut, new_table
from tracewell.operators.pyast import FINDING_SCHEMA, function_facts, scopes_of, traced_calls

_CWE = {"SQL Injection": "CWE-89", "Command Injection": "CWE-78", "Path Traversal": "CWE-22"}


def _parsed(lines: list[str] | None) -> ast.Module | None:
    try:
        return ast.parse("\n".join(lines or []))
    except (SyntaxError, ValueError, RecursionError):
        return None


_FACT = pa.struct([("kind", pa.string()), ("param", pa.int32()), ("what", pa.string()), ("arg", pa.int32())])
_SOURCE = pa.struct([("conditions", pa.list_(pa.struct([("callee_of", pa.string()), ("arg_of", pa.int32())]))), ("text", pa.string())])
_FUNCTION = {"place": pa.int32(), "name": pa.string(), "params": pa.list_(pa.string()), "facts": pa.list_(_FACT)}
_CALL = {"line_number": pa.int32(), "callee": pa.string(), "arg": pa.int32(), "sources": pa.list_(_SOURCE), "arg_text": pa.string(), "code_snippet": pa.string()}


def _function_rows(scopes: list[ast.AST]) -> Iterator[tuple]:
    for place, func in enumerate(scopes[1:]):
        facts = [{"kind": k, "param": p, "what": w, "arg": a} for k, p, w, a in dict.fromkeys(function_facts(func))]
        yield place, func.name, [a.arg for a in func.args.args], facts


def _call_rows(tree: ast.Module, scopes: list[ast.AST]) -> Iterator[tuple]:
    for line, callee, arg, found, text, snippet in traced_calls(tree, scopes):
        yield line, callee, arg, [{"conditions": [{"callee_of": c, "arg_of": k} for c, k in conditions], "text": t} for conditions, t in found], text, snippet


def _modules(files: DataFrame, with_calls: bool) -> DataFrame:
    """Functions and, if asked, calls that get outside data, of each Python file that parses: a row is one or the other, with its path.

    A file is parsed once. Of functions of one name those that can't be the last are left out as far as a batch shows.
    """
    kinds = {"file_path": pa.string()} | _FUNCTION | (_CALL if with_calls else {})
    schema = pa.schema(list(kinds.items()))
    own, other = (None,) * len(_FUNCTION), (None,) * (len(kinds) - len(_FUNCTION) - 1)

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        last: dict[str, tuple] = {}
        for path, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (tree := _parsed(lines)) is None:
                continue
            scopes = scopes_of(tree)
            for row in _function_rows(scopes):
                at = path is not None, path or "", row[0]
                if row[1] not in last or last[row[1]][0] < at:
                    last[row[1]] = at, (path, *row, *other)
            if with_calls:
                yield from ((path, *own, *row) for row in _call_rows(tree, scopes))
        yield from (row for _, row in last.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            collects = gc.isenabled()
            gc.disable()  # trees have no cycles, but many objects that the collector would go through again and again
            try:
                rows = list(rows_of(batch))
            finally:
                if collects:
                    gc.enable()
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], schema=schema)

    return files.where("language = 'python'").select("file_path", "lines").mapInArrow(run, from_arrow_schema(schema))


def _last_of_name(found: DataFrame) -> DataFrame:
    last = found.where("name is not null").groupBy("name").agg(F.max(F.struct("file_path", *[c for c in _FUNCTION if c != "name"])).alias("f"))  # combined before the shuffle
    return last.select("name", "f.file_path", "f.params", "f.facts")


def functions_of(files: DataFrame) -> DataFrame:
    """name, file_path, params, facts: of functions of one name the last by path and place counts."""
    return _last_of_name(_modules(files, with_calls=False))


def return_parameters(functions: DataFrame) -> DataFrame:
    """name, param: parameters whose value a function returns, through any of its names and calls."""
    return functions.select("name", F.explode("facts").alias("x")).where("x.kind = 'return'").select("name", "x.param").distinct()


def _doubled(jumps: DataFrame) -> DataFrame:
    """Where following ``jumps`` (node, to), one a node, ends, in a number of rounds that grows with the logarithm of the longest path.

    Nodes on or before a cycle, which has no end, are left out.
    """
    rounds = jumps.count().bit_length()
    for _ in range(rounds + 1):
        after = jumps.select(F.col("node").alias("to"), F.col("to").alias("later"))
        jumps = cut(jumps.join(after, "to", "left").select("node", F.coalesce("later", "to").alias("to"), F.col("later").isNotNull().alias("moved")), "jumps")
        moved, jumps = jumps.where("moved").select(F.lit(1)), jumps.drop("moved")
        if not moved.take(1):
            return jumps
    return jumps.join(jumps.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to")


def sink_parameters(functions: DataFrame) -> DataFrame:
    """name, param, type: parameters of ``functions`` (one row a name) that reach a sink, through any chain of calls.

    Parameters and the arguments they are passed as form a graph. Calls of what is no sink and passes nothing on are left out. A
    parameter that then goes to one place alone is a link of a chain; chains are shortened to their ends by doubling, and only the
    rest of the graph is searched round by round, each round joining what the last one found. A chain of n links takes about log2(n)
    rounds; cycles end because known facts are dropped.
    """
    spark = functions.sparkSession
    # All facts of a node stand in the row of its function, each once, so they need no shuffle to be told apart.
    held = functions.select("name", F.explode(F.array_distinct(F.transform(F.filter("facts", lambda x: x["kind"] != "return"), lambda x: x["param"]))).alias("param"), "facts")
    of_kind = lambda kind: F.filter("facts", lambda x: (x["kind"] == kind) & (x["param"] == F.col("param")))
    called = F.transform(of_kind("call"), lambda x: F.struct(x["what"].alias("name"), x["arg"].alias("param")))
    nodes = cut(held.select(F.struct("name", "param").alias("node"), F.array_distinct(F.transform(of_kind("sink"), lambda x: x["what"])).alias("types"), F.array_distinct(called).alias("to")), "nodes")
    sinks = nodes.select("node", F.explode("types").alias("type"))
    calls = nodes.select("node", F.explode("to").alias("to"), (F.size("types") == 0).alias("plain"))
    edges = cut(calls.join(nodes.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to", "plain"), "calls")
    single = edges.groupBy("node").agg(F.count("*").alias("n"), F.first("to").alias("to"), F.first("plain").alias("plain")).where("n = 1 and plain").select("node", "to")
    ends = _doubled(cut(single, "links"))
    links = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
    rest = edges.select("node", "to").join(ends.select("node"), "node", "left_anti")
    rest = cut(rest.join(links, "to", "left").select("node", F.coalesce("end", "to").alias("to")).distinct(), "branches")
    table, frontier = new_table(spark, "reached"), sinks
    while True:
        frontier = cut(frontier, "frontier")
        frontier.write.mode("append").parquet(table)
        known = spark.read.schema(frontier.schema).parquet(table)
        if not frontier.take(1):
            break
        reached = rest.join(frontier.select(F.col("node").alias("to"), "type"), "to").select("node", "type").distinct()
        frontier = reached.join(known, ["node", "type"], "left_anti")
    chained = ends.join(known.select(F.col("node").alias("to"), "type"), "to").select("node", "type")
    return known.union(chained).select("node.name", "node.param", "type").distinct()


def resolved(calls: DataFrame, returns: DataFrame) -> DataFrame:
    """``calls`` with ``source``: of ``sources`` the last whose conditions are all among ``returns`` (name, param).

    Only numbers of calls and their conditions are joined with ``returns``; calls of one source are not joined at all.
    """
    key = [c for c in calls.columns if c != "sources"]
    numbered = cut(calls.withColumn("call", F.monotonically_increasing_id()), "taint-calls")
    asked = numbered.where(F.size("sources") > 1).select("call", F.posexplode("sources").alias("k", "s")).select("call", "k", F.explode("s.conditions").alias("c")).select("call", "k", "c.*").where("callee_of is not null")
    given = returns.select(F.col("name").alias("callee_of"), F.col("param").alias("arg_of"))
    failed = asked.join(given, ["callee_of", "arg_of"], "left_anti").groupBy("call").agg(F.collect_set("k").alias("failed"))
    several = numbered.where(F.size("sources") > 1).join(failed, "call", "left")
    holds = F.filter("sources", lambda s, k: ~F.coalesce(F.array_contains("failed", k), F.lit(False)))
    last = several.select(*key, holds.alias("holds")).where(F.size("holds") > 0).select(*key, F.element_at("holds", -1)["text"].alias("source"))
    return numbered.where(F.size("sources") <= 1).select(*key, F.get("sources", F.lit(0))["text"].alias("source")).unionByName(last)


#: Calls of what this part of all calls names are dealt out over so many places.
OFTEN, PLACES = 1 / 100, 64


def _joined(calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """``calls`` with the sinks of callee and argument. Sinks that many calls name, a hundred at most, stand in several places."""
    least = calls.count() * OFTEN
    often = [r.callee for r in calls.groupBy("callee").count().where(F.col("count") > least).collect()]
    if not often:
        return calls.join(sinks, ["callee", "arg"])
    named = F.col("callee").isin(often)
    dealt = calls.withColumn("place", F.when(named, F.pmod(F.xxhash64("file_path", "line_number"), F.lit(PLACES)).cast("int")).otherwise(0))
    places = F.when(named, F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(sinks.withColumn("place", F.explode(places)), ["callee", "arg", "place"]).drop("place")


def taint_findings(files: DataFrame) -> DataFrame:
    """Findings where outside data is passed to a parameter that reaches a sink; one per file and line, types in order."""
    modules = cut(_modules(files, with_calls=True), "modules")
    functions = cut(_last_of_name(modules), "functions")
    sinks = sink_parameters(functions).join(functions.select("name", "params"), "name")
    calls = modules.where("callee is not null").select("file_path", *_CALL)
    hits = _joined(calls, sinks.select(F.col("name").alias("callee"), F.col("param").alias("arg"), "type", "params"))
    hits = resolved(hits, return_parameters(functions))
    cwe = F.lit("CWE-89")
    for kind, value in _CWE.items():
        cwe = F.when(F.col("type") == kind, value).otherwise(cwe)
    sink = F.concat(F.lit("Call to "), F.col("callee"), F.lit("() passing tainted arg '"), F.col("arg_text"), F.lit("' to sink param '"), F.get("params", F.col("arg")), F.lit("'"))
    out = hits.select(
        "file_path", "line_number", F.lit("TAINT-CROSS-FILE-001").alias("rule_id"), F.col("type").alias("vulnerability_type"), F.lit("CRITICAL").alias("severity"), F.lit(5).alias("severity_value"),
        F.lit(0.85).alias("confidence_score"), cwe.alias("cwe_id"), "source", sink.alias("sink"), "code_snippet",
    )
    return out.repartition("file_path").distinct()  # dealt out as one_per_line needs it


def one_per_line(findings: DataFrame) -> DataFrame:
    """Of findings of one rule, line and file the first by type, as a scan reports them."""
    columns = [c.split()[0] for c in FINDING_SCHEMA.split(", ")]
    rest = [c for c in columns if c not in ("file_path", "rule_id", "line_number")]
    least = findings.groupBy("file_path", "rule_id", "line_number").agg(F.min(F.struct("vulnerability_type", *[c for c in rest if c != "vulnerability_type"])).alias("f"))
    return least.select("file_path", "rule_id", "line_number", "f.*").select(columns)
