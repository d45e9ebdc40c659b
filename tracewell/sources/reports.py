"""Reports of findings: JSON, SARIF, HTML and text, and saved JSON reports as findings."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.findings import compliance_status, fingerprint, first_per, rank_order, severity_value, summary, with_compliance, with_derived

SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, in a column ``value``; tasks write them side by side as JSON lines."""
    full = with_compliance(with_derived(findings))
    return full.select(F.to_json(F.struct(*[c for c in full.columns], F.col("vulnerability_type").alias("vulnerability"), F.col("confidence_percent").alias("confidence"))).alias("value"))


def write_json(findings: DataFrame, path: str) -> None:
    """``path/findings`` as JSON lines and ``path/summary`` with the counts; nothing is gathered on the driver."""
    json_rows(findings).write.mode("overwrite").text(f"{path}/findings")
    summary(findings).coalesce(1).write.mode("overwrite").json(f"{path}/summary")  # one row


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a saved report with a list ``findings``; unknown types become Unknown."""
    schema = "findings array<struct<file_path:string,line_number:int,rule_id:string,vulnerability_type:string,severity:string,confidence_score:double,cwe_id:string,source:string,sink:string,code_snippet:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("findings").alias("f")).select("f.*")
    return rows.withColumn("severity", F.upper("severity")).withColumn("severity_value", severity_value(F.col("severity"))).fillna({"vulnerability_type": "Unknown", "rule_id": "UNKNOWN"})


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id, level, uri, start_line, fingerprint, result (the SARIF result as JSON)."""
    level = F.lit("warning")
    for name, value in SARIF_LEVEL.items():
        level = F.when(F.col("severity") == name, value).otherwise(level)
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.when(F.col("line_number") >= 1, F.struct(F.col("line_number").alias("startLine"))).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("vulnerability_type").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(fingerprint().alias("primaryLocationLineHash")).alias("partialFingerprints"))
    return findings.select("rule_id", level.alias("level"), F.col("file_path").alias("uri"), F.col("line_number").alias("start_line"), fingerprint().alias("fingerprint"), F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The rule catalogue of a SARIF run: each rule as its first finding by rank defines it."""
    first = first_per(findings, ["rule_id"], rank_order())
    number = F.regexp_replace("cwe_id", "CWE-", "")
    return first.select(
        F.col("rule_id").alias("id"), F.replace("vulnerability_type", F.lit(" "), F.lit("")).alias("name"), F.col("vulnerability_type").alias("short_description"),
        F.when(F.col("cwe_id").isNotNull(), F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html"))).alias("help_uri"),
    )


def html_report(findings: DataFrame, title: str, most: int = 500) -> str:
    """A page with the summary, compliance and the first ``most`` findings by rank."""
    s = summary(findings).first()
    esc = lambda v: html.escape("" if v is None else str(v))
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    columns = ["severity", "rule_id", "file_path", "line_number", "vulnerability_type", "confidence_score"]
    top = findings.orderBy(*rank_order()).select(columns).limit(most).collect()
    status = compliance_status(findings).collect()
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1>{table(list(s.asDict()), [s])}{table(['framework', 'violations', 'status'], status)}{table(columns, top)}</body></html>"


def text_report(findings: DataFrame, most: int = 50) -> str:
    s = summary(findings).first()
    rows = findings.orderBy(*rank_order()).limit(most).collect()
    return "\n".join([f"{s.total} findings, risk {s.risk_level} ({s.risk_score})", *(f"{r.severity:<8} {r.rule_id} {r.file_path}:{r.line_number} {r.vulnerability_type}" for r in rows)])
