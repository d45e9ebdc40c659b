"""Operators on findings: suppression, overrides, rescoring, merging, ranking, roll-ups and evaluation.

A findings DataFrame has at least file_path, line_number, rule_id, vulnerability_type, severity, severity_value, confidence_score,
cwe_id, source, sink, code_snippet.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import split_lines, strip
from tracewell.operators.compliance import FRAMEWORKS, rows
from tracewell.operators.cut import cut, fold_flagged, fold_groups
from tracewell.operators.rulespec import SEVERITIES

# Words, families, weights and distances that decide results.
SANITISED = r"(?i)\b(?:shlex\s*\.\s*quote|quote|escapeShell|escape|sanitize|strip|replace|replaceAll)\b"
INTERPRETERS = ("SQL Injection", "Command Injection", "Code Injection")
FAMILIES = ("SQLI", "CMD", "SECRET", "XSS", "SSRF", "PT", "DESER", "CRYPTO", "XXE", "NOSQL", "CONFIG")
MERGE_LINES, MERGE_BOOST = 10, 0.20
RISK = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1, "INFO": 0}


def severity_value(severity: Column) -> Column:
    """1 (INFO) to 5 (CRITICAL); null for anything else."""
    out = F.lit(None).cast("int")
    for name, value in SEVERITIES.items():
        out = F.when(F.upper(severity) == name, value).otherwise(out)
    return out


def severity_name(value: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), value)


def with_derived(findings: DataFrame) -> DataFrame:
    """Adds confidence_tier, confidence_percent (ties to even), location and has_taint_flow."""
    score = F.col("confidence_score")
    return findings.withColumns(
        {
            "confidence_tier": F.when(score >= 0.80, "HIGH").when(score >= 0.50, "MEDIUM").otherwise("LOW"),
            "confidence_percent": F.bround(score * 100).cast("int"),
            "location": F.when(F.col("line_number").isNull(), F.col("file_path")).otherwise(F.concat_ws(":", "file_path", F.col("line_number").cast("string"))),
            "has_taint_flow": F.col("source").isNotNull() & F.col("sink").isNotNull(),
        }
    )


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity_value") >= SEVERITIES[severity.upper()])


def gate_fails(findings: DataFrame, severity: str | None = None) -> bool:
    """Whether any finding is as severe as that, or there is any at all."""
    return bool((at_least(findings, severity) if severity else findings).take(1))


# Suppression and overrides


def allowlisted(findings: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Without what an entry (file_path, rule_id, line_number) names; an entry's null rule or line matches any."""
    entries = allowlist.select(F.col("file_path").alias("e_path"), F.col("rule_id").alias("e_rule"), F.col("line_number").alias("e_line")).where("e_path is not null")
    rule = F.col("e_rule").isNull() | (F.col("e_rule") == "") | (F.upper("e_rule") == F.upper("rule_id"))
    line = F.col("e_line").isNull() | F.col("e_line").eqNullSafe(F.col("line_number"))
    return findings.join(entries, (F.col("file_path") == F.col("e_path")) & rule & line, "left_anti")


def ignore_condition(patterns: Iterable[str]) -> Column:
    """Whether a line of an ignore file (``glob`` or ``glob:RULE``) names the finding's path; ``*`` crosses slashes."""
    out = F.lit(False)
    for text in (p.strip() for p in patterns):
        if not text or text.startswith("#"):
            continue
        glob, _, rule = text.rpartition(":") if ":" in text else (text, "", "*")
        glob = glob.strip().removeprefix("./").rstrip("/") or "."
        forms = [fnmatch.translate(g) for g in (glob, f"*/{glob}", f"{glob}/*")]
        regex = "|".join(f.replace("\\Z", "$").replace("\\z", "$") for f in forms)
        hit = F.col("file_path").rlike(f"^(?:{regex})")
        out = out | (hit if rule.strip() == "*" else hit & (F.upper("rule_id") == rule.strip().upper()))
    return out


def without_ignored(findings: DataFrame, patterns: Iterable[str]) -> DataFrame:
    return findings.where(~F.coalesce(ignore_condition(patterns), F.lit(False)))


def comment_suppresses(lines: Column, line_number: Column, rule_id: Column, marker: str) -> Column:
    """Whether the line or the one above carries ``marker: ignore``, alone or with this rule's id after it."""

    def on(line: Column) -> Column:
        own = F.regexp_extract(line, rf"(?i){marker}:\s*ignore(?:\s+(\S+))?", 1)
        return line.rlike(rf"(?i){marker}:\s*ignore") & ((own == "") | (F.upper(own) == F.upper(rule_id)))

    above = F.when(line_number > 1, on(F.get(lines, line_number - 2))).otherwise(False)
    return F.coalesce((line_number >= 1) & (line_number <= F.size(lines)) & (above | on(F.get(lines, line_number - 1))), F.lit(False))


def without_commented(findings: DataFrame, files: DataFrame, marker: str) -> DataFrame:
    """Without findings that a comment in their file suppresses. Only lines with the marker are joined.

    A file's marked lines are few; findings of other files pass through without a match.
    """
    marked = files.select(F.col("file_path").alias("m_path"), F.posexplode("lines").alias("at", "text")).where(F.col("text").rlike(rf"(?i){marker}:\s*ignore"))
    own = F.regexp_extract("text", rf"(?i){marker}:\s*ignore(?:\s+(\S+))?", 1)
    marked = marked.select("m_path", (F.col("at") + 1).alias("m_line"), own.alias("m_rule"))
    near = F.col("m_line").isin(F.col("line_number"), F.col("line_number") - 1)
    hit = (F.col("file_path") == F.col("m_path")) & near & ((F.col("m_rule") == "") | (F.upper("m_rule") == F.upper("rule_id")))
    return findings.join(marked, hit, "left_anti")


def with_overrides(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Severities replaced by exact rule id; names that are no severity are passed over."""
    valid = {k: v.upper() for k, v in overrides.items() if v.upper() in SEVERITIES}
    if not valid:
        return findings
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in valid.items() for x in kv])[F.col("rule_id")], F.col("severity"))
    return findings.withColumn("severity", name).withColumn("severity_value", severity_value(F.col("severity")))


# Rescoring and merging


def rescored(findings: DataFrame) -> DataFrame:
    """Confidence raised by a source, a sink and an exposed interpreter, lowered by a sanitiser; severity by the new confidence."""
    present = lambda c: F.coalesce(strip(F.col(c)) != "", F.lit(False))
    clean = lambda c: F.coalesce(F.col(c).rlike(SANITISED), F.lit(False))
    exposed, secret = F.col("vulnerability_type").isin(*INTERPRETERS), F.col("vulnerability_type") == "Hardcoded Secret"
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    total = F.col("confidence_score") + add(present("source"), 0.15) + add(present("sink"), 0.15) + add(clean("code_snippet") | clean("sink"), -0.40) + add(exposed, 0.10)
    scored = findings.withColumn("confidence_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    c = F.col("confidence_score")
    name = (
        F.when(c < 0.30, "INFO")
        .when(exposed, F.when(c >= 0.70, "CRITICAL").when(c >= 0.50, "HIGH").otherwise("MEDIUM"))
        .when(secret, F.when(c >= 0.80, "CRITICAL").otherwise("HIGH"))
        .otherwise(F.when(c >= 0.75, "HIGH").when(c >= 0.50, "MEDIUM").otherwise("LOW"))
    )
    return scored.withColumn("severity", name).withColumn("severity_value", severity_value(F.col("severity")))


def rule_family(rule_id: Column) -> Column:
    """The first family whose name the id contains, else the id."""
    out = F.upper(rule_id)
    for name in reversed(FAMILIES):
        out = F.when(F.upper(rule_id).contains(name), name).otherwise(out)
    return out


def near_pairs(internal: DataFrame, external: DataFrame, distance: int = MERGE_LINES) -> DataFrame:
    """Pairs of findings of one file and type whose lines are ``distance`` or less apart, with the boosted confidence.

    An equi-join on file, type and a bucket of lines; the external side goes to its own bucket and both neighbours, so that a
    large file is spread over its lines.
    """
    bucket = F.floor(F.col("line_number") / (distance + 1))
    left = internal.where("line_number is not null").withColumn("bucket", bucket)
    right = external.where("line_number is not null").select(*[F.col(c).alias(f"x_{c}") for c in external.columns])
    right = right.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("x_line_number") / (distance + 1)) + k for k in (-1, 0, 1)])))
    same = (F.col("file_path") == F.col("x_file_path")) & (F.col("vulnerability_type") == F.col("x_vulnerability_type")) & (left["bucket"] == right["bucket"])
    pairs = left.join(right, same).where(F.abs(F.col("line_number") - F.col("x_line_number")) <= distance).drop("bucket")
    related = F.coalesce(F.upper(F.trim("cwe_id")) == F.upper(F.trim("x_cwe_id")), F.lit(False)) | (rule_family(F.col("rule_id")) == rule_family(F.col("x_rule_id")))
    top = F.greatest("confidence_score", "x_confidence_score")
    return pairs.withColumn("merged_confidence", F.when(related, F.least(F.lit(1.0), top + MERGE_BOOST)).otherwise(top))


def _family(rule_id: str) -> str:
    return next((f for f in FAMILIES if f in rule_id.upper()), rule_id.upper())


def merge_file(rows_: list[dict]) -> Iterator[dict]:
    """Findings of one file and type: each external one joins the first internal one that is near, or stays by itself."""
    own = [r for r in rows_ if r["engine"] != "external"]
    own.sort(key=lambda r: (-r["severity_value"], -r["confidence_score"], r["emit_seq"]))
    for row in sorted((r for r in rows_ if r["engine"] == "external"), key=lambda r: r["emit_seq"]):
        line = row["line_number"]
        mate = None if line is None else next((r for r in own if r["line_number"] is not None and abs(r["line_number"] - line) <= MERGE_LINES), None)
        if mate is None:
            yield row
            continue
        a, b = mate["cwe_id"] or "", row["cwe_id"] or ""
        related = bool(a) and a.strip().upper() == b.strip().upper() or _family(mate["rule_id"]) == _family(row["rule_id"])
        top = max(mate["confidence_score"], row["confidence_score"])
        mate["confidence_score"] = min(1.0, top + MERGE_BOOST) if related else top
        mate["rule_id"] = f"{mate['rule_id']} + {row['rule_id']}"
    yield from own


def merged(findings: DataFrame) -> DataFrame:
    """Internal and external findings (``engine``; order by ``emit_seq``) with near ones of a file and type merged, one by one.

    A merge changes confidence and rule id, which later merges see, so neighbours are folded in order. Findings that no gap of
    over ``MERGE_LINES`` lines parts are a run, and only runs of both engines are folded; all others, and those without a line, pass.
    """
    keys = ["file_path", "vulnerability_type"]
    by_line = Window.partitionBy(*keys).orderBy(F.col("line_number").asc_nulls_first())
    gap = F.when(F.col("line_number") - F.lag("line_number").over(by_line) > MERGE_LINES, 1).otherwise(0)
    runs = findings.withColumn("__run", gap).withColumn("__run", F.sum("__run").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    whole, outside = Window.partitionBy(*keys, "__run"), F.coalesce(F.col("engine") == "external", F.lit(False))
    both = F.max(outside).over(whole) & F.max(~outside).over(whole) & F.col("line_number").isNotNull()
    return fold_flagged(runs.withColumn("__both", both), [*keys, "__run"], "__both", merge_file, findings.schema)


def organisation_totals(results: DataFrame) -> DataFrame:
    """Per organisation the repositories scanned and failed, of (organisation, repository, status); a status of null counts as neither."""
    failed = F.col("status").isin("clone_failed", "error")
    return results.groupBy("organisation").agg(F.count_if(F.col("status") == "scanned").alias("scanned"), F.count_if(failed).alias("failed"))


def first_repositories(repositories: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` repositories in their listed order; all of them if that is 0."""
    return repositories.orderBy(*order).limit(most) if most > 0 else repositories


# Ranking


def rank_order() -> list[Column]:
    """Severity and confidence falling, then file and line (null as 0), then rule id for ties."""
    return [F.desc("severity_value"), F.desc("confidence_score"), F.asc("file_path"), F.coalesce("line_number", F.lit(0)).asc(), F.asc("rule_id")]


def ranked(findings: DataFrame, tie: Iterable[str] = ()) -> DataFrame:
    """Adds ``rank``, from 1 over all findings, without gathering them in one task.

    Findings are range-partitioned and sorted; a finding's rank is its place in its partition plus what earlier partitions
    hold, of which there is one row each.
    """
    order = [*rank_order(), *[F.asc(c) for c in tie]]
    placed = findings.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed, "ranked")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))  # a row per partition
    local = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + local + 1).drop("part", "base", "place")


def first_per(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first finding of each key."""
    return findings.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


# Roll-ups


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


def summary(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by severity, total, risk score and risk level; of all findings, or by group."""
    counts = [count_if(F.col("severity") == s).cast("long").alias(s.lower()) for s in RISK]
    out = findings.groupBy(*(by or [])).agg(*counts, F.count("*").alias("total"))
    score = sum((F.col(s.lower()) * w for s, w in RISK.items()), F.lit(0))
    level = F.when((F.col("critical") > 0) | (F.col("risk_score") >= 20), "CRITICAL").when(F.col("risk_score") >= 10, "HIGH").when(F.col("risk_score") >= 3, "MEDIUM").when(F.col("risk_score") >= 1, "LOW").otherwise("CLEAR")
    return out.withColumn("risk_score", score.cast("long")).withColumn("risk_level", level)


def by_severity(findings: DataFrame) -> DataFrame:
    """severity, n for all severities, zero where there is none."""
    spark = findings.sparkSession
    names = F.broadcast(spark.createDataFrame([(s, v) for s, v in SEVERITIES.items()], "severity string, severity_value int"))  # five rows
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return names.join(counts, "severity", "left").select("severity", "severity_value", F.coalesce("n", F.lit(0)).alias("n"))


def controls(findings: DataFrame) -> DataFrame:
    """One row per finding and control that its CWE maps to: adds framework, control."""
    spark = findings.sparkSession
    known = F.broadcast(spark.createDataFrame(rows(), "cwe_no string, framework string, control string"))  # a fixed few rows
    number = F.trim(F.regexp_replace(F.upper("cwe_id"), "CWE-", ""))
    return findings.withColumn("cwe_no", number).join(known, "cwe_no", "left").drop("cwe_no")


def with_compliance(findings: DataFrame) -> DataFrame:
    """Adds ``compliance``, a map from framework to control; empty for an unknown or null CWE. No shuffle."""
    maps: dict[str, list] = {}
    for cwe, framework, control in rows():
        maps.setdefault(cwe, []).append((framework, control))
    number = F.trim(F.regexp_replace(F.upper("cwe_id"), "CWE-", ""))
    out = F.create_map().cast("map<string,string>")
    for cwe, pairs in maps.items():
        out = F.when(number == cwe, F.create_map(*[F.lit(x) for p in pairs for x in p])).otherwise(out)
    return findings.withColumn("compliance", out)


def compliance_status(findings: DataFrame) -> DataFrame:
    """framework, violations, status for the five frameworks."""
    names = F.broadcast(findings.sparkSession.createDataFrame([(f,) for f in FRAMEWORKS], "framework string"))  # five rows
    counts = controls(findings).where("framework is not null").groupBy("framework").agg(F.count("*").alias("violations"))
    out = names.join(counts, "framework", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    return out.withColumn("status", F.when(F.col("violations") > 0, "Non-Compliant").otherwise("Compliant"))


def by_group(findings: DataFrame, group: str) -> DataFrame:
    """group, files, findings, max_severity."""
    return findings.groupBy(group).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("findings"), severity_name(F.max("severity_value")).alias("max_severity"))


def types_by_file(findings: DataFrame) -> DataFrame:
    """file_path and its distinct types, sorted and joined."""
    return findings.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("vulnerability_type")), ", ").alias("types"))


def fingerprint() -> Column:
    """SHA-256 of the snippet, or of rule, file and line where there is none."""
    place = F.concat(F.col("rule_id"), F.lit(":"), F.col("file_path"), F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("None")))
    return F.sha2(F.when(F.coalesce(F.col("code_snippet"), F.lit("")) != "", F.col("code_snippet")).otherwise(place), 256)


def source_line(lines: Column, line_number: Column, source: Column) -> Column:
    """The nearest of up to eleven lines above that holds the source, else the line above (1 at least)."""
    low, high = F.greatest(F.lit(1), line_number - 11), F.least(F.size(lines), line_number - 1)
    above = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    found = F.array_max(F.filter(above, lambda i: F.element_at(lines, i).contains(source)))
    return F.when(F.coalesce(source, F.lit("")) == "", line_number).otherwise(F.coalesce(found, F.greatest(F.lit(1), line_number - 1)))


# Evaluation


def match_line(rows_: list[dict]) -> Iterator[dict]:
    """Expected findings of one file and line, in order, each take the first detected one whose rule id contains theirs."""
    free = [r["rule_id"] for r in sorted((r for r in rows_ if r["detected"]), key=lambda r: r["seq"])]
    wanted = [r["rule_id"] for r in sorted((r for r in rows_ if not r["detected"]), key=lambda r: r["seq"])]
    hits = 0
    for rule in wanted:
        k = next((k for k, r in enumerate(free) if rule in r), None)
        if k is not None:
            hits += 1
            del free[k]
    yield {"file_path": rows_[0]["file_path"], "tp": hits, "fn": len(wanted) - hits, "fp": len(free)}


def evaluated(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """file_path, tp, fn, fp by one-to-one matching on file, line and rule id (detected contains expected)."""
    cols = ["file_path", "line_number", "rule_id", "seq"]
    both = expected.select(*cols, F.lit(False).alias("detected")).unionByName(detected.select(*cols, F.lit(True).alias("detected")))
    by_line = fold_groups(both, ["file_path", "line_number"], match_line, "file_path string, tp long, fn long, fp long")
    return by_line.groupBy("file_path").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))


def rates(evaluation: DataFrame, files: DataFrame) -> DataFrame:
    """tp, fp, fn, tn (files without expected or detected findings), tpr, fpr, precision; 0 where a denominator is 0."""
    clean = files.select("file_path").distinct().join(evaluation.where("tp + fn + fp > 0").select("file_path"), "file_path", "left_anti").agg(F.count("*").alias("tn"))
    sums = evaluation.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    out = sums.crossJoin(clean)  # one row each
    return out.withColumns({"tpr": ratio(F.col("tp"), F.col("fn")), "fpr": ratio(F.col("fp"), F.col("tn")), "precision": ratio(F.col("tp"), F.col("fp"))})


def _near_lines(lines: DataFrame, distance: int, **keys: str) -> DataFrame:
    """Lines with new names (``line_number`` is ``near_line``), each under the buckets of lines that can be within ``distance`` of it."""
    at = F.floor(F.col("line_number") / (distance + 1))
    named = [F.col(old).alias(new) for new, old in keys.items()]
    return lines.where("line_number is not null").select(*named, F.col("line_number").alias("near_line"), F.explode(F.array(at - 1, at, at + 1)).alias("near_bucket"))


def _within(distance: int) -> Column:
    return (F.floor(F.col("line_number") / (distance + 1)) == F.col("near_bucket")) & (F.abs(F.col("line_number") - F.col("near_line")) <= distance)


def still_vulnerable(original: DataFrame, rescan: DataFrame, distance: int = 5) -> DataFrame:
    """Original findings that a finding of the same file and type within ``distance`` lines shows again."""
    new = _near_lines(rescan, distance, n_path="file_path", n_type="vulnerability_type")
    return original.join(new, (F.col("file_path") == F.col("n_path")) & (F.col("vulnerability_type") == F.col("n_type")) & _within(distance), "left_semi")


def introduced(original: DataFrame, rescan: DataFrame, distance: int = 20) -> DataFrame:
    """Findings of HIGH or above that no original one of the same type and rule within ``distance`` lines explains."""
    old = _near_lines(original, distance, o_path="file_path", o_type="vulnerability_type", o_rule="rule_id")
    same = (F.col("file_path") == F.col("o_path")) & (F.col("vulnerability_type") == F.col("o_type")) & (F.col("rule_id") == F.col("o_rule"))
    return at_least(rescan, "HIGH").join(old, same & _within(distance), "left_anti")


def lines_of(code: DataFrame) -> DataFrame:
    """``lines`` from ``code``."""
    return code.withColumn("lines", split_lines(F.col("code")))

