"""Auditors' JSON reports as findings. ``reports``: file_path, report (JSON text); a report that doesn't parse gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.findings import severity_value
from tracewell.operators.rulespec import SEVERITIES

AUDIT = ["file_path", "rule_id", "vulnerability_type", "severity", "severity_value", "confidence_score", "cwe_id", "recommendation", "references", "code_snippet"]
_VULN = "array<struct<id:string,cve:string,description:string,fix_versions:string>>"
_ITEM = f"array<struct<name:string,version:string,vulns:{_VULN},vulnerabilities:{_VULN}>>"
DEPENDENCY = "Dependency Vulnerability"


def _severity(text: Column) -> Column:
    return F.when(F.upper(text).isin(*SEVERITIES), F.upper(text)).otherwise("HIGH")


def _audit(df: DataFrame, rule: Column, severity: Column, confidence: Column, cwe: Column, advice: Column, references: Column, snippet: Column) -> DataFrame:
    made = {"rule_id": rule, "vulnerability_type": F.lit(DEPENDENCY), "severity": severity, "confidence_score": confidence, "cwe_id": cwe, "recommendation": advice, "references": references, "code_snippet": snippet}
    return df.select("file_path", *[c.alias(n) for n, c in made.items()]).withColumn("severity_value", severity_value(F.col("severity"))).select(AUDIT)


def python_audit(reports: DataFrame) -> DataFrame:
    """A list of packages, or an object with them under dependencies, results or vulnerabilities; one finding per vulnerability."""
    keyed = F.from_json("report", f"struct<dependencies:{_ITEM},results:{_ITEM},vulnerabilities:{_ITEM}>")
    full = lambda c: F.when(F.size(c) > 0, c)
    items = F.when(F.ltrim("report").startswith("["), F.from_json("report", _ITEM)).otherwise(F.coalesce(full(keyed["dependencies"]), full(keyed["results"]), full(keyed["vulnerabilities"])))
    packages = reports.withColumn("item", F.explode(items)).select("file_path", "item.*")
    found = packages.withColumn("v", F.explode(F.coalesce(full(F.col("vulns")), full(F.col("vulnerabilities"))))).select("file_path", "name", "version", "v.*")
    fixes = F.filter(F.coalesce(F.from_json("fix_versions", "array<string>"), F.array("fix_versions")), lambda x: x.isNotNull() & (x != ""))
    advice = F.concat(F.lit("Upgrade "), "name", F.when(F.size(fixes) > 0, F.concat(F.lit(" to one of: "), F.array_join(fixes, ", "))).otherwise(" to the latest secure version."))
    vid = F.coalesce("id", F.lit("UNKNOWN"))
    links = F.when(vid.startswith("GHSA-"), F.array(F.concat(F.lit("https://github.com/advisories/"), vid))).otherwise(F.array().cast("array<string>"))
    return _audit(found, F.concat(F.lit("SCA-"), vid), F.lit("HIGH"), F.lit(0.9), F.lit("CWE-1104"), advice, links, F.concat("name", F.lit("=="), "version"))


def npm_audit(reports: DataFrame) -> DataFrame:
    """Version 2 reports (``vulnerabilities``, with objects or names under ``via``) and version 1 reports (``advisories``)."""
    top = reports.withColumn("top", F.from_json("report", "struct<vulnerabilities:map<string,string>,advisories:map<string,string>>"))
    package = F.from_json("value", "struct<severity:string,via:string,range:string,fixAvailable:string>")
    v2 = top.select("file_path", F.explode("top.vulnerabilities")).withColumn("p", package)
    via = F.coalesce(F.when(F.ltrim("p.via").startswith("["), F.from_json("p.via", "array<string>")), F.array("p.via"))
    v2 = v2.withColumn("via", F.explode(via)).where("via is not null")
    o = F.from_json("via", "struct<title:string,url:string,cwe:string>")
    is_object = F.ltrim("via").startswith("{")
    cwes = o["cwe"]
    cwe = F.when(cwes.startswith("["), F.coalesce(F.get(F.from_json(cwes, "array<string>"), F.lit(0)), F.lit("CWE-1104"))).otherwise(F.coalesce(cwes, F.lit("CWE-1104")))
    title = F.coalesce(o["title"], F.concat(F.lit("Vulnerable dependency in "), "key"))
    fixed = F.get_json_object("p.fixAvailable", "$.version")
    advice = F.when(fixed.isNotNull(), F.concat(F.lit("Upgrade "), "key", F.lit(" to version "), fixed, F.lit("."))).otherwise(F.concat(F.lit("Audit and upgrade dependency "), "key", F.lit(". "), title))
    none = F.array().cast("array<string>")
    links = F.when(o["url"].isNotNull(), F.array(o["url"])).otherwise(none)
    quoted = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    own = _audit(v2.where(is_object), quoted("SCA-NPM-", F.col("key")), _severity(F.coalesce("p.severity", F.lit("high"))), F.lit(0.9), cwe, advice, links, quoted('"', F.col("key"), '": "', F.coalesce("p.range", F.lit("*")), '"'))
    parent = _audit(
        v2.where(~is_object), quoted("SCA-NPM-", F.col("key")), _severity(F.coalesce("p.severity", F.lit("high"))), F.lit(0.8), F.lit("CWE-1104"),
        quoted("Upgrade dependency ", F.col("key"), " or parent dependency ", F.col("via"), "."), none, quoted('"', F.col("key"), '" via parent "', F.col("via"), '"'),
    )
    a = F.from_json("value", "struct<module_name:string,severity:string,title:string,url:string,cwe:string,patched_versions:string,findings:array<struct<version:string>>>")
    v1 = top.select("file_path", F.explode("top.advisories")).withColumn("a", a).select("file_path", "a.*")
    name = F.coalesce("module_name", F.lit("unknown"))
    old = _audit(
        v1, quoted("SCA-NPM-", name), _severity(F.coalesce("severity", F.lit("high"))), F.lit(0.9), F.when(F.col("cwe").startswith("["), "CWE-1104").otherwise(F.coalesce("cwe", F.lit("CWE-1104"))),
        quoted("Upgrade ", name, " to version ", F.coalesce("patched_versions", F.lit("latest")), ". (", F.coalesce("title", F.lit("Vulnerable dependency")), ")"),
        F.when(F.col("url").isNotNull(), F.array("url")).otherwise(none), quoted('"', name, '": "', F.coalesce(F.get("findings", F.lit(0))["version"], F.lit("*")), '"'),
    )
    return own.unionByName(parent).unionByName(old)


def pattern_report(reports: DataFrame) -> DataFrame:
    """Results of an external pattern engine: type by check id, severity and confidence by name, CWE from metadata or type."""
    schema = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<lines:string,message:string,severity:string,metadata:struct<confidence:string,cwe:array<string>,references:array<string>>>>>>"
    r = reports.select(F.explode(F.from_json("report", schema)["results"]).alias("r")).select("r.*")
    check = F.coalesce("check_id", F.lit("external-rule"))
    low = F.lower(check)
    kind = F.when(low.contains("sqli"), "SQL Injection").when(low.contains("cmd"), "Command Injection").when(low.contains("secret"), "Hardcoded Secret").otherwise("Unknown")
    level = F.upper(F.coalesce("extra.severity", F.lit("WARNING")))
    sure = F.upper(F.coalesce("extra.metadata.confidence", F.lit("MEDIUM")))
    severity = F.when(level == "ERROR", "CRITICAL").when(level == "WARNING", "HIGH").otherwise("MEDIUM")
    fallback = F.when(kind == "SQL Injection", "CWE-89").when(kind == "Command Injection", "CWE-78").when(kind == "Hardcoded Secret", "CWE-798")
    return r.select(
        F.coalesce("path", F.lit("")).alias("file_path"), F.col("start.line").alias("line_number"), F.concat(F.lit("EXT-"), F.upper(check)).alias("rule_id"), kind.alias("vulnerability_type"),
        severity.alias("severity"), severity_value(severity).alias("severity_value"), F.when(sure == "HIGH", 0.85).when(sure == "MEDIUM", 0.65).otherwise(0.40).alias("confidence_score"),
        F.coalesce(F.get("extra.metadata.cwe", F.lit(0)), fallback).alias("cwe_id"), F.nullif(F.trim("extra.lines"), F.lit("")).alias("code_snippet"),
    )
