"""One scan of a tree by settings: what it reads, which rules run, what is passed over, its faults, and figures that it observes."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.catalogue import RULES
from tracewell.operators.cut import cut
from tracewell.operators.findings import at_least, with_overrides
from tracewell.operators.ignores import without_patterns
from tracewell.operators.registry import checked, readable
from tracewell.operators.rulespec import Rule
from tracewell.operators.scan import scan
from tracewell.sources.files import read_files
from tracewell.sources.settings import DEFAULTS

FAULT = "kind string, file_path string, line_number int, rule_id string, error string"


@dataclass(frozen=True)
class Scanned:
    """``findings``; ``faults`` (kind, file_path, line_number, rule_id, error); ``statistics``, one row."""

    findings: DataFrame
    faults: DataFrame
    statistics: DataFrame


def scan_files(files: DataFrame, settings: dict[str, dict] = DEFAULTS, ignore: DataFrame | None = None, rules: Iterable[Rule] = RULES, longest: int = 10_000) -> Scanned:
    """Scan ``files`` (file_path, language, lines) by all ``rules`` that can run.

    Severities are overridden, then findings below the least severity and those that a line of ``ignore`` names are left out. A rule that
    can't run and a file with a line of over ``longest`` characters, which is not scanned, are faults. Files and findings are counted
    while the scan runs, without another pass; the findings are written to the shared folder.
    """
    spark, scanning, begun = files.sparkSession, settings["scanning"], time.monotonic()
    given = list(rules)
    able, broken = checked(spark, given)
    seen, found = Observation("files"), Observation("findings")
    counted = files.observe(seen, F.count("*").alias("files"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines"))
    kept, long = readable(counted, longest)
    findings = at_least(with_overrides(scan(kept, catalogue=able), scanning["severity_overrides"]), scanning["min_severity"])
    if ignore is not None:
        findings = without_patterns(findings, ignore)
    findings = cut(findings.observe(found, F.count("*").alias("findings"), F.count_if(F.col("severity_value") >= 4).alias("severe")), "findings")
    none = F.lit(None).cast("string")
    faults = long.select(F.lit("line").alias("kind"), "file_path", F.col("line_number").cast("int").alias("line_number"), none.alias("rule_id"), F.concat(F.col("n_chars").cast("string"), F.lit(" characters on a line")).alias("error"))
    faults = cut(faults.unionByName(broken.select(F.lit("rule").alias("kind"), none.alias("file_path"), F.lit(None).cast("int").alias("line_number"), "rule_id", "error")), "faults")
    figures = seen.get | found.get
    row = (figures["files"], figures["lines"], sum(r.enabled for r in able), len(given) - len(able), figures["findings"], figures["severe"], time.monotonic() - begun)
    return Scanned(findings, faults, spark.createDataFrame([row], "files long, lines long, rules_run int, rules_failed int, findings long, severe long, seconds double"))


def scan_tree(spark: SparkSession, root: str, settings: dict[str, dict] = DEFAULTS, ignore: DataFrame | None = None, rules: Iterable[Rule] = RULES) -> Scanned:
    """``scan_files`` over a tree: sizes, folders and extensions are those of the settings."""
    s = settings["scanning"]
    files = read_files(spark, root, excluded=tuple(s["exclude_dirs"]), most_bytes=s["max_file_size_kb"] * 1024, without=tuple(s["exclude_extensions"]))
    return scan_files(files, settings, ignore, rules)
