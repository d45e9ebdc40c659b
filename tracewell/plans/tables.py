"""Findings, events and reports derived from the driver's tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.rulespec import SEVERITIES, quoted

KINDS = [
    ("PY-SQLI-001", "SQL Injection", "CRITICAL", "CWE-89"),
    ("PY-CMD-001", "Command Injection", "CRITICAL", "CWE-78"),
    ("PSEC-XSS-PY-001", "Cross-Site Scripting (XSS)", "HIGH", "CWE-79"),
    ("PSEC-CRYPTO-PY-001", "Weak Cryptography", "MEDIUM", "CWE-327"),
    ("PSEC-PT-PY-001", "Path Traversal", "HIGH", "cwe-22 "),
    ("SECRET-001", "Hardcoded Secret", "CRITICAL", "CWE-798"),
    ("IAC-DKR-001", "Security Misconfiguration", "LOW", "CWE-1104"),
    ("INFO-001", "Unknown", "INFO", None),
]

_LIST = lambda k: "[" + ", ".join("NULL" if r[k] is None else quoted(r[k]) for r in KINDS) + "]"
FINDINGS_SQL = f"""findings AS (SELECT 'src/f' || l_orderkey || '.py' AS file_path,
  CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(l_partkey % 60 + 1 AS INTEGER) END AS line_number,
  {_LIST(0)}[l_suppkey % 8 + 1] AS rule_id, {_LIST(1)}[l_suppkey % 8 + 1] AS vulnerability_type, {_LIST(2)}[l_suppkey % 8 + 1] AS severity,
  [5, 5, 4, 3, 4, 5, 2, 1][l_suppkey % 8 + 1] AS severity_value, l_discount * 10 AS confidence_score, {_LIST(3)}[l_suppkey % 8 + 1] AS cwe_id,
  CASE WHEN l_linestatus = 'O' THEN 'user_input' END AS source,
  CASE l_linenumber % 3 WHEN 0 THEN 'escape(x)' WHEN 1 THEN 'run(q)' END AS sink,
  CASE WHEN l_linenumber % 2 = 0 THEN 'q = ' || l_partkey END AS code_snippet,
  CASE WHEN l_returnflag = 'R' THEN 'external' ELSE 'internal' END AS engine, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS emit_seq
  FROM lineitem)"""


#: Where a row stands in the table: its file, and its place in that.
PLACE = ["_metadata.file_name", "_metadata.row_index"]


def derived_findings(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """One finding per line item; ``more`` columns of the table follow."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = (F.col("l_suppkey") % 8).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in KINDS]), at)
    return items.select(
        F.concat(F.lit("src/f"), F.col("l_orderkey"), F.lit(".py")).alias("file_path"),
        F.when(F.col("l_quantity") != 13, (F.col("l_partkey") % 60 + 1).cast("int")).alias("line_number"),
        pick(0).alias("rule_id"), pick(1).alias("vulnerability_type"), pick(2).alias("severity"),
        F.get(F.array(*[F.lit(SEVERITIES[r[2]]) for r in KINDS]), at).alias("severity_value"), (F.col("l_discount") * 10).alias("confidence_score"), pick(3).alias("cwe_id"),
        F.when(F.col("l_linestatus") == "O", "user_input").alias("source"),
        F.when(F.col("l_linenumber") % 3 == 0, "escape(x)").when(F.col("l_linenumber") % 3 == 1, "run(q)").alias("sink"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("q = "), F.col("l_partkey"))).alias("code_snippet"),
        F.when(F.col("l_returnflag") == "R", "external").otherwise("internal").alias("engine"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("emit_seq"),
        *more,
    )
