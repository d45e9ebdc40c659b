"""``python -m tracewell scan ROOT`` and ``python -m tracewell report REPORT``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.cut import cut
from tracewell.operators.entry import scan_tree
from tracewell.operators.findings import allowlisted, at_least, gate_fails, rescored, with_overrides
from tracewell.operators.ignores import without_patterns
from tracewell.sources.lists import read_allowlist
from tracewell.sources.reports import html_report, json_rows, read_json, sarif_results, text_report
from tracewell.sources.settings import ignore_lines, load_settings


def show(findings: DataFrame, form: str, out: str | None) -> None:
    """Text and HTML hold the first findings by rank; JSON and SARIF are written by tasks to the folder ``out``."""
    if form == "text":
        print(text_report(findings))
    elif form == "html":
        print(html_report(findings, "Findings"))
    else:
        (json_rows(findings) if form == "json" else sarif_results(findings).selectExpr("result as value")).write.mode("overwrite").text(out or "findings")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewell")
    p.add_argument("command", choices=["scan", "report"])
    p.add_argument("path")
    p.add_argument("--format", choices=["text", "html", "json", "sarif"], default="text")
    p.add_argument("--out")
    p.add_argument("--min-severity", help="INFO, or what the settings say")
    p.add_argument("--fail-on")
    p.add_argument("--settings", help="a JSON file")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--ignore-file")
    p.add_argument("--allowlist", help="a JSON file")
    p.add_argument("--override", action="append", default=[], metavar="RULE=SEVERITY")
    p.add_argument("--rescore", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    settings = load_settings(a.settings)
    scanning = settings["scanning"]
    if not a.settings:
        scanning["min_severity"] = "INFO"
    scanning |= {"min_severity": a.min_severity or scanning["min_severity"], "severity_overrides": scanning["severity_overrides"] | dict(x.split("=", 1) for x in a.override)}
    ignore = spark.createDataFrame([(x,) for x in [*a.ignore, *(ignore_lines(a.ignore_file) if a.ignore_file else [])]], "line string")
    if a.command == "scan":
        done = scan_tree(spark, a.path, settings | {"scanning": scanning | {"min_severity": "INFO"}})
        findings, stats = done.findings, done.statistics.first()
        print(f"{stats.files} files, {stats.rules_run} rules, {stats.rules_failed} failed, {stats.seconds:.1f} s", file=sys.stderr)
    else:
        findings = with_overrides(read_json(spark, a.path), scanning["severity_overrides"])
    if a.allowlist:
        findings = allowlisted(findings, read_allowlist(spark, a.allowlist))
    findings = at_least(rescored(findings) if a.rescore else findings, scanning["min_severity"])
    findings = cut(without_patterns(findings, ignore), "reported")
    show(findings, a.format, a.out)
    return int(gate_fails(findings, a.fail_on))


if __name__ == "__main__":
    sys.exit(main())
