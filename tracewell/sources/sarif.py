"""A whole SARIF run: results with code flows and fixes, the rules they name, and the document around them.

The document is written by tasks, in parts that follow each other by name: head, rules, results by rank, tail. Put together they are
one JSON text; nothing is gathered on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.findings import fingerprint, ranked, source_line
from tracewell.operators.patch import REWRITERS, patch_checked
from tracewell.operators.registry import recommendation
from tracewell.sources.reports import SARIF_LEVEL, SCHEMA

Hunk = tuple[int, int, list[str]]


def line_edits(before: list[str], after: list[str]) -> list[Hunk]:
    """The shortest edit script from one list of lines to another: (first, end, lines) of ``before`` to be replaced, ascending.

    Furthest-reaching paths by diagonal, for one edit more at a time; so the work grows with the lines times the edits.
    """
    top = 0
    while top < min(len(before), len(after)) and before[top] == after[top]:
        top += 1
    a, b = before[top:], after[top:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    reached, history = {1: 0}, []
    for edits in range(len(a) + len(b) + 1):
        history.append(dict(reached))
        for k in range(-edits, edits + 1, 2):
            x = reached[k + 1] if k == -edits or k != edits and reached[k - 1] < reached[k + 1] else reached[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reached[k] = x
            if x >= len(a) and x - k >= len(b):
                return _hunks(history, a, b, k, top)
    return []


def _hunks(history: list[dict[int, int]], a: list[str], b: list[str], k: int, top: int) -> list[Hunk]:
    x, y, steps = len(a), len(b), []
    for edits in range(len(history) - 1, 0, -1):
        reached = history[edits]
        down = k == -edits or k != edits and reached[k - 1] < reached[k + 1]
        k = k + 1 if down else k - 1
        x, y = reached[k], reached[k] - k
        steps.append((x, y, down))
    out: list[Hunk] = []
    for x, y, down in reversed(steps):
        if not out or out[-1][1] != top + x or not down and out[-1][2] and out[-1][1] < top + x:
            out.append((top + x, top + x, []))
        first, end, lines = out[-1]
        out[-1] = (first, end, [*lines, b[y]]) if down else (first, end + 1, lines)
    return out


def replacements(before: list[str], after: list[str], ending: str) -> list[dict]:
    """SARIF replacements, by lines and columns from 1, that make ``after`` of ``before``."""
    out = []
    for first, end, lines in line_edits(before, after):
        if end > first and lines:
            place, text = (first + 1, 1, end, len(before[end - 1]) + 1), ending.join(lines)
        elif end > first and end < len(before):
            place, text = (first + 1, 1, end + 1, 1), ""
        elif end > first:  # the last lines go, and the ending before them
            place, text = (first, len(before[first - 1]) + 1, end, len(before[end - 1]) + 1) if first else (1, 1, end, len(before[end - 1]) + 1), ""
        elif first < len(before):
            place, text = (first + 1, 1, first + 1, 1), "".join(x + ending for x in lines)
        else:
            place, text = (first, len(before[-1]) + 1, first, len(before[-1]) + 1), "".join(ending + x for x in lines)
        region = dict(zip(("startLine", "startColumn", "endLine", "endColumn"), place))
        out.append({"deletedRegion": region, "insertedContent": {"text": text}})
    return out


def suggested_fixes(files: DataFrame, findings: DataFrame) -> DataFrame:
    """file_path, line_number, vulnerability_type, replacements (JSON): what the patch of that finding alone would replace.

    Findings that no rewriter knows, and those whose patch is given up, have no row.
    """
    suffix = F.lower(F.regexp_extract("file_path", r"(\.[^./]*)$", 1))
    known = F.struct("vulnerability_type", suffix.alias("suffix")).isin(*[F.struct(F.lit(k), F.lit(s)) for k, s in REWRITERS])
    wanted = findings.where(known & (F.col("line_number") >= 1)).groupBy("file_path").agg(F.collect_set(F.struct("line_number", "vulnerability_type")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lines, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for place in places:
                    number, kind = place["line_number"], place["vulnerability_type"]
                    code = patch_checked(path, "\n".join(lines or []), [(number, kind)])[0]
                    made = replacements(lines or [], code.split("\n"), "\n")
                    if made:
                        rows.append((path, number, kind, json.dumps(made, ensure_ascii=False)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file_path", "line_number", "vulnerability_type", "replacements"])

    rows = files.select("file_path", "lines").join(wanted, "file_path")
    return rows.mapInArrow(run, "file_path string, line_number int, vulnerability_type string, replacements string")


def source_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """file_path, line_number, source, source_line: where the source of a finding last stands before its line.

    Findings are gathered by file as places, so that a file's lines are met once.
    """
    places = findings.where("source <> '' and line_number is not null").groupBy("file_path").agg(F.collect_set(F.struct("line_number", "source")).alias("places"))
    rows = files.select("file_path", "lines").join(places, "file_path").select("file_path", "lines", F.explode("places").alias("p"))
    return rows.select("file_path", "p.line_number", "p.source", source_line(F.col("lines"), F.col("p.line_number"), F.col("p.source")).alias("source_line"))


def _place(line: Column) -> Column:
    region = F.when(line >= 1, F.struct(line.alias("startLine")))
    return F.struct(F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region"))


def code_flow(source_at: Column) -> Column:
    """The code flow from a finding's source to its sink; null without a line."""
    said = lambda column, text, otherwise: F.when(F.coalesce(F.col(column), F.lit("")) == "", otherwise).otherwise(F.concat(F.lit(text + " '"), F.col(column), F.lit("'")))
    step = lambda at, text: F.struct(F.struct(_place(at).alias("physicalLocation"), F.struct(text.alias("text")).alias("message")).alias("location"), F.lit("essential").alias("importance"))
    source = step(source_at, said("source", "Taint source: variable/input", "Taint source: dynamic user input"))
    sink = step(F.col("line_number"), said("sink", "Taint sink: execution flow reaches", "Taint sink: vulnerability execution site"))
    return F.when(F.col("line_number") >= 1, F.array(F.struct(F.array(F.struct(F.array(source, sink).alias("locations"))).alias("threadFlows"))))


def with_flows(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``source_line``: that of the source if the file is known, the line before if it isn't, the own line without source."""
    known = source_lines(files, findings)
    before = F.greatest(F.lit(1), F.col("line_number") - 1)
    joined = findings.join(known, ["file_path", "line_number", "source"], "left").select(*[findings[c] for c in findings.columns], known["source_line"].alias("found"))
    return joined.withColumn("source_line", F.when(F.coalesce(F.col("source"), F.lit("")) == "", F.col("line_number")).otherwise(F.coalesce("found", before))).drop("found")


def run_results(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``rank``, ``source_line`` and ``result``, the whole SARIF result as JSON, over ``files`` (file_path, lines)."""
    fixes = suggested_fixes(files, findings)
    on = ["file_path", "line_number", "vulnerability_type"]
    rows = ranked(with_flows(findings, files), ("sink",)).join(fixes, on, "left")
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SARIF_LEVEL.items() for x in kv]), F.col("severity")), F.lit("warning"))
    change = "array<struct<deletedRegion:struct<startLine:int,startColumn:int,endLine:int,endColumn:int>,insertedContent:struct<text:string>>>"
    replaced = F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.from_json("replacements", change).alias("replacements"))
    fix = F.when(F.col("replacements").isNotNull(), F.array(F.struct(F.struct(F.concat(F.lit("Suggested fix for "), "rule_id").alias("text")).alias("description"), F.array(replaced).alias("fileChanges"))))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(recommendation(F.col("vulnerability_type"), F.col("cwe_id")).alias("text")).alias("message"),
        F.array(F.struct(_place(F.col("line_number")).alias("physicalLocation"))).alias("locations"), F.struct(fingerprint().alias("primaryLocationLineHash")).alias("partialFingerprints"),
        code_flow(F.col("source_line")).alias("codeFlows"), fix.alias("fixes"),
    )
    return rows.select(*findings.columns, "rank", "source_line", F.to_json(result).alias("result"))


def run_document(findings: DataFrame, files: DataFrame, scanner: str = "tracewell") -> DataFrame:
    """section, at, text: the lines of the document, in the order of section and place; an element that isn't its list's first begins
    with a comma."""
    spark = findings.sparkSession
    results = run_results(findings, files)
    comma = lambda at, text: F.concat(F.when(at > 1, ",").otherwise(""), text)
    number = F.regexp_replace(F.upper("cwe_id"), "CWE-", "")
    first = results.groupBy("rule_id").agg(F.min(F.struct("rank", "vulnerability_type", "cwe_id")).alias("f")).select("rule_id", "f.*")
    rule = F.struct(
        F.col("rule_id").alias("id"), F.replace("vulnerability_type", F.lit(" "), F.lit("")).alias("name"), F.struct(F.col("vulnerability_type").alias("text")).alias("shortDescription"),
        F.struct(recommendation(F.col("vulnerability_type"), F.col("cwe_id")).alias("text")).alias("fullDescription"),
        F.struct(F.lit("high").alias("precision"), F.when(F.col("cwe_id").isNotNull(), F.array(F.lit("security"), F.upper("cwe_id"))).alias("tags")).alias("properties"),
        F.when(F.col("cwe_id").isNotNull(), F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html"))).alias("helpUri"),
    )
    head = f'{{"$schema":{json.dumps(SCHEMA)},"version":"2.1.0","runs":[{{"columnKind":"unicodeCodePoints","tool":{{"driver":{{"name":{json.dumps(scanner)},"rules":['
    fixed = spark.createDataFrame([(0, 0, head), (2, 0, ']}},"results":['), (4, 0, "]}]}")], "section int, at long, text string")
    rules = first.select(F.lit(1).alias("section"), F.col("rank").alias("at"), comma(F.col("rank"), F.to_json(rule)).alias("text"))
    return fixed.unionByName(rules).unionByName(results.select(F.lit(3).alias("section"), F.col("rank").alias("at"), comma(F.col("rank"), F.col("result")).alias("text")))


def write_run(findings: DataFrame, files: DataFrame, path: str, scanner: str = "tracewell") -> None:
    """``path``: part files that, one after the other by name, are the SARIF document."""
    lines = run_document(findings, files, scanner)
    lines.repartitionByRange("section", "at").sortWithinPartitions("section", "at").select("text").write.mode("overwrite").text(path)
