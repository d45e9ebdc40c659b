"""Rules as data that users add, switch off and keep in files, and what went wrong with them as rows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.catalogue import RULES
from tracewell.operators.rulespec import SEVERITIES, Match, Rule

SPEC = (
    "rule_id string, languages array<string>, sink string, kind string, severity string, cwe string, source string, ignore_case boolean, before int, after int, threshold double, "
    "enabled boolean, references array<string>, signals array<struct<weight: double, scope: string, pattern: string, ignore_case: boolean>>"
)
#: Rules are held by the driver and written into the plan, so there can't be more than this.
MOST_RULES = 1000
ERROR = "rule_id string, error string"


class Registry:
    """A set of rules with unique ids."""

    def __init__(self, rules: Iterable[Rule] = RULES):
        self._rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> Rule:
        if not isinstance(rule, Rule):
            raise TypeError(f"not a rule: {rule!r}")
        if rule.rule_id in self._rules:
            raise ValueError(f"{rule.rule_id} is registered already")
        self._rules[rule.rule_id] = rule
        return rule

    def unregister(self, rule_id: str) -> None:
        self._rules.pop(rule_id, None)

    def enable(self, rule_id: str, enabled: bool = True) -> None:
        self._rules[rule_id] = replace(self._rules[rule_id], enabled=enabled)

    def rules(self, language: str | None = None, include_disabled: bool = False) -> list[Rule]:
        """By rule id: the rules for a language (any case; ``*`` in a rule means all), or all."""
        fits = lambda r: language is None or "*" in r.languages or language.lower() in (x.lower() for x in r.languages)
        return [r for _, r in sorted(self._rules.items()) if (include_disabled or r.enabled) and fits(r)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """rule_id, language, severity, enabled: one row per rule and language."""
        rows = [(r.rule_id, language, r.severity, r.enabled) for r in self.rules(include_disabled=True) for language in r.languages]
        return spark.createDataFrame(rows, "rule_id string, language string, severity string, enabled boolean")


def registry_stats(rules: DataFrame) -> DataFrame:
    """total, enabled and disabled rules, and the sorted languages, of a registry's frame."""
    count = lambda c: F.count_distinct(F.when(c, F.col("rule_id"))).alias
    return rules.agg(
        F.count_distinct("rule_id").alias("total"), count(F.col("enabled"))("enabled"), count(~F.col("enabled"))("disabled"),
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"),
    )


def _fault(rule: Rule) -> str | None:
    """What is wrong with a rule's fields, or nothing."""
    if not rule.rule_id or not rule.languages or not rule.sink:
        return "rule_id, languages and sink are needed"
    if rule.severity not in SEVERITIES:
        return f"unknown severity {rule.severity}"
    if any(isinstance(c, Match) and c.scope not in ("line", "w", "sink") for _, c in rule.signals):
        return "scope is line, w or sink"
    return None


def _tried(spark: SparkSession, rules: list[Rule]) -> dict[str, str]:
    """Errors of the rules whose patterns don't run, by rule id: all are tried at once, and halves of those that fail."""
    if not rules:
        return {}
    try:
        tried = [c for r in rules for c in (F.col("line").rlike(r.regex), *(c.column() for _, c in r.signals))]
        spark.sql("SELECT 'a' AS line, 'a' AS line_low, 'a' AS w, 'a' AS w_low, 'a' AS sink FROM range(1)").select(*[c.alias(f"c{k}") for k, c in enumerate(tried)]).collect()
        return {}
    except (PySparkException, re.PatternError) as e:
        if len(rules) == 1:
            return {rules[0].rule_id: str(e).splitlines()[0][:300]}
    half = len(rules) // 2
    return _tried(spark, rules[:half]) | _tried(spark, rules[half:])


def checked(spark: SparkSession, rules: Iterable[Rule]) -> tuple[list[Rule], DataFrame]:
    """The rules that can run, and (rule_id, error) rows for the others: one bad pattern doesn't end a scan."""
    rules = list(rules)
    faults = {r.rule_id: fault for r in rules if (fault := _fault(r)) is not None}
    faults |= _tried(spark, [r for r in rules if r.rule_id not in faults])
    return [r for r in rules if r.rule_id not in faults], spark.createDataFrame(sorted(faults.items()), ERROR)


def read_rules(spark: SparkSession, path: str) -> tuple[list[Rule], DataFrame]:
    """Rules of a file or folder of JSON lines (columns as in ``SPEC``), and what is wrong with the others.

    Missing fields take a rule's defaults. No code is loaded. More than ``MOST_RULES`` rules are an error.
    """
    rows = spark.read.schema(SPEC).json(path).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in {path}")
    rules = []
    for row in rows:
        given = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
        signals = tuple((float(s["weight"] or 0), Match(s["scope"] or "line", s["pattern"] or "", bool(s["ignore_case"]))) for s in given.pop("signals", []))
        needed = {"rule_id": "", "languages": [], "sink": "", "kind": "Unknown", "severity": "MEDIUM", "cwe": "", "source": ""} | given
        rules.append(Rule(**needed | {"languages": tuple(needed["languages"]), "references": tuple(given.get("references", [])), "signals": signals}))
    return checked(spark, rules)


def readable(files: DataFrame, longest: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Files whose lines can all be matched, and (file_path, line_number, n_chars) of the lines that are longer than ``longest``,
    as a pattern may go back over a line many times."""
    long = F.exists("lines", lambda x: F.length(x) > longest)
    lines = files.where(long).select("file_path", F.posexplode("lines").alias("pos", "line")).where(F.length("line") > longest)
    return files.where(~long), lines.select("file_path", (F.col("pos") + 1).alias("line_number"), F.length("line").alias("n_chars"))


def recommendation(category: Column, reference: Column) -> Column:
    """Advice for a finding without one of its own, by its category and first reference."""
    refer = F.coalesce(F.nullif(reference, F.lit("")), F.lit("OWASP Top 10"))
    return F.concat(F.lit("Review the "), category, F.lit(" vulnerability at the flagged location and apply appropriate sanitisation or safe API usage. Refer to: "), refer, F.lit("."))
