"""Registered queries on findings, files and reports, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import context_window, line_count, split_lines, strip
from tracewell.operators import findings as ops
from tracewell.operators.catalogue import BY_ID, RULES, SECRET
from tracewell.operators.compliance import FRAMEWORKS, rows
from tracewell.operators.cut import cut
from tracewell.operators.entry import scan_files
from tracewell.operators.ignores import without_patterns
from tracewell.operators.pyast import ast_findings
from tracewell.operators.rulespec import SEVERITIES, Rule, quoted
from tracewell.operators.scan import scan, sink_sites
from tracewell.operators.taint import functions_of, one_per_line, sink_parameters, taint_findings
from tracewell.plans.corpus import FILES_SQL, dealt, derived_files
from tracewell.plans.oracle import last_user_sql, rule_ctes, rule_sql, strip_sql
from tracewell.plans.tables import FINDINGS_SQL, PLACE, derived_findings
from tracewell.sources.audits import npm_audit, pattern_report, python_audit
from tracewell.sources.files import changed_only, language_of
from tracewell.sources.reports import json_rows, sarif_results, sarif_rules
from tracewell.sources.sarif import code_flow, run_document, with_flows
from tracewell.sources.settings import DEFAULTS
from tracewell.streaming.jobs import answers, job_registry, queued_jobs
from tracewell.streaming.watch import hmac_sha256, latest_buffers, scan_jobs, snapshot_changes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COLUMNS = "file_path, line_number, rule_id, vulnerability_type, severity, severity_value, confidence_score, cwe_id, source, sink, code_snippet, engine, emit_seq"
VALUE_OF = "CASE severity " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in SEVERITIES.items()) + " END"
COMPLIANCE_SQL = "controls(cwe, framework, control) AS (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in rows()) + ")"
CWE_NUMBER = "trim(replace(upper(cwe_id), 'CWE-', ''))"


def query(sql: str | None = None):
    """Register the function under its name, with the SQL of the oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Sources and line primitives


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - (CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS INTEGER) AS n_lines, CAST(len(text) - len(replace(text, chr(10), '')) + (CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS INTEGER) AS line_count FROM documents")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(split_lines(F.col("text"))).alias("n_lines"), line_count(F.col("text")).cast("int").alias("line_count"))


@query(f"WITH {FILES_SQL} SELECT language AS lang, team, count(*) AS files FROM files WHERE language IS NOT NULL GROUP BY 1, 2")
def lang_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = derived_files(spark, sf_dir).withColumn("lang", language_of(F.col("file_path"))).where("lang is not null")
    return routed.groupBy("lang", "team").agg(F.count("*").alias("files"))


@query(f"WITH RECURSIVE {FILES_SQL}, {rule_ctes(BY_ID['PY-CMD-001'])} SELECT file_path, CAST(line_number AS INTEGER) AS line_number, sink FROM sites")
def sink_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink_sites(derived_files(spark, sf_dir), [BY_ID["PY-CMD-001"]]).select("file_path", "line_number", "sink")


@query(f"""WITH {FILES_SQL}, l AS (SELECT file_path, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM files)
SELECT file_path, CAST(n AS INTEGER) AS line_number, array_to_string(list(line) OVER (PARTITION BY file_path ORDER BY n ROWS BETWEEN 10 PRECEDING AND 3 FOLLOWING), chr(10)) AS w FROM l""")
def ctx_window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived_files(spark, sf_dir).select("file_path", "lines", F.posexplode("lines").alias("at", "line"))
    return lines.select("file_path", (F.col("at") + 1).alias("line_number"), context_window(F.col("lines"), F.col("at") + 1, 10, 4).alias("w"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT 'doc/' || doc_id AS file_path, CAST(n AS INTEGER) AS line_number, left({strip_sql(f"regexp_extract(line, {quoted('(?i)' + SECRET)}, 0)")}, 80) AS sink FROM l WHERE regexp_matches(line, {quoted('(?i)' + SECRET)})""")
def secrets_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir).select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file_path"), F.lit("text").alias("language"), split_lines(F.col("text")).alias("lines"))
    return scan(files, ["SECRET-001"]).select("file_path", "line_number", "sink")


SCAN_SQL = "\nUNION ALL ".join(f"SELECT * FROM ({sql})" for sql in [*(rule_sql(r) for r in RULES), last_user_sql()])


@query(SCAN_SQL)
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(derived_files(spark, sf_dir))


@query("WITH RECURSIVE " + FILES_SQL + ", " + rule_ctes(BY_ID["PSEC-CRYPTO-PY-001"]) + " SELECT file_path, CAST(min(line_number) AS INTEGER) AS line_number, 'PSEC-CRYPTO-PY-001' AS rule_id FROM windows GROUP BY file_path")
def first_hit_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(derived_files(spark, sf_dir), ["PSEC-CRYPTO-PY-001"], first_hit=True).select("file_path", "line_number", "rule_id")


@query(f"WITH {FILES_SQL} SELECT file_path, language FROM files WHERE file_path IN (SELECT 'src/f' || l_orderkey || '.py' FROM lineitem WHERE l_linenumber = 1)")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 1").select(F.concat(F.lit("src/f"), F.col("l_orderkey"), F.lit(".py")).alias("file_path"))
    return changed_only(derived_files(spark, sf_dir), changed).select("file_path", "language")


# Filters, suppression, overrides


@query(f"WITH {FINDINGS_SQL} SELECT {COLUMNS} FROM findings WHERE severity_value >= 4")
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.at_least(derived_findings(spark, sf_dir), "HIGH")


@query(f"WITH {FINDINGS_SQL}, o AS (SELECT * REPLACE (CASE rule_id WHEN 'PY-CMD-001' THEN 'LOW' WHEN 'INFO-001' THEN 'HIGH' ELSE severity END AS severity) FROM findings) SELECT emit_seq, severity, {VALUE_OF} AS severity_value FROM o")
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = {"PY-CMD-001": "low", "INFO-001": "HIGH", "SECRET-001": "nonsense"}
    return ops.with_overrides(derived_findings(spark, sf_dir), overrides).select("emit_seq", "severity", "severity_value")


@query(f"""WITH {FINDINGS_SQL}, allow AS (SELECT 'src/f' || o_orderkey || '.py' AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'py-sqli-001' END AS r, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey % 60 + 1 AS INTEGER) END AS n FROM orders WHERE o_orderkey % 5 = 0)
SELECT {COLUMNS} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM allow WHERE p = f.file_path AND (r IS NULL OR upper(r) = upper(f.rule_id)) AND (n IS NULL OR n IS NOT DISTINCT FROM f.line_number))""")
def allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 5 = 0")
    allow = orders.select(F.concat(F.lit("src/f"), F.col("o_orderkey"), F.lit(".py")).alias("file_path"), F.when(F.col("o_orderkey") % 3 == 0, "py-sqli-001").alias("rule_id"), F.when(F.col("o_orderkey") % 4 == 1, (F.col("o_custkey") % 60 + 1).cast("int")).alias("line_number"))
    return ops.allowlisted(derived_findings(spark, sf_dir), allow)


@query(f"WITH {FINDINGS_SQL} SELECT {COLUMNS} FROM findings WHERE NOT (file_path GLOB 'src/f1*.py' AND rule_id = 'PY-CMD-001') AND NOT file_path GLOB 'src/f?3.py'")
def suppress_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.without_ignored(derived_findings(spark, sf_dir), ["# note", "src/f1*.py:py-cmd-001", "f?3.py", ""])


@query(f"""WITH {FINDINGS_SQL}, g AS (SELECT 'f' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '?.py' ELSE '*.py' END AS pattern, CASE WHEN o_orderkey % 3 = 0 THEN 'PY-CMD-001' ELSE '*' END AS rule FROM orders WHERE o_orderkey % 29 = 0),
p AS (SELECT DISTINCT file_path FROM findings), i AS (SELECT DISTINCT file_path, rule FROM p, g WHERE file_path GLOB ('*/' || pattern) OR file_path GLOB pattern)
SELECT {COLUMNS} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.file_path = f.file_path AND i.rule IN ('*', f.rule_id))""")
def suppress_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(key % 29 == 0)
    line = F.concat(F.lit("./f"), key, F.when(key % 2 == 0, "?.py").otherwise("*.py"), F.when(key % 3 == 0, " : py-cmd-001").otherwise(""))
    return without_patterns(derived_findings(spark, sf_dir), orders.select(line.alias("line")))


@query(f"""WITH {FILES_SQL}, n AS (SELECT count(*) AS files, CAST(sum(len(lines)) AS BIGINT) AS lines FROM files), f AS (SELECT count(*) AS findings, count_if(severity_value >= 4) AS severe FROM ({SCAN_SQL}))
SELECT files, lines, {len(RULES)}::INTEGER AS rules_run, 1::INTEGER AS rules_failed, findings, severe FROM n, f""")
def scan_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = Rule("ORG-BROKEN-001", ("*",), "(", "Unknown", "LOW", "", "")
    settings = DEFAULTS | {"scanning": DEFAULTS["scanning"] | {"min_severity": "INFO"}}
    return scan_files(derived_files(spark, sf_dir), settings, rules=[*RULES, broken]).statistics.drop("seconds")


@query(f"""WITH {FINDINGS_SQL}, marks AS (SELECT 'src/f' || o_orderkey || '.py' AS p, CAST(o_custkey % 60 + 1 AS INTEGER) AS n, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'py-sqli-001' END AS r FROM orders)
SELECT {COLUMNS} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM marks WHERE p = f.file_path AND n IN (f.line_number, f.line_number - 1) AND (r = '' OR upper(r) = upper(f.rule_id)))""")
def suppress_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.col("o_custkey") % 60
    mark = F.when(F.col("o_orderkey") % 2 == 0, "x = 1  # tracewell: ignore").otherwise("x = 1  # Tracewell: ignore py-sqli-001")
    files = orders.select(F.concat(F.lit("src/f"), F.col("o_orderkey"), F.lit(".py")).alias("file_path"), F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.when(i == at, mark).otherwise("pass")).alias("lines"))
    return ops.without_commented(derived_findings(spark, sf_dir), files, "tracewell")


# Rescoring, merging, ranking

RESCORED_SQL = f"""{FINDINGS_SQL}, a AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence_score + (CASE WHEN trim(coalesce(source, '')) <> '' THEN 0.15::DOUBLE ELSE 0::DOUBLE END)
  + (CASE WHEN trim(coalesce(sink, '')) <> '' THEN 0.15::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN regexp_matches(coalesce(code_snippet, ''), {quoted(ops.SANITISED)}) OR regexp_matches(coalesce(sink, ''), {quoted(ops.SANITISED)}) THEN -0.40::DOUBLE ELSE 0::DOUBLE END)
  + (CASE WHEN vulnerability_type IN ('SQL Injection', 'Command Injection', 'Code Injection') THEN 0.10::DOUBLE ELSE 0::DOUBLE END))) AS c FROM findings),
rescored AS (SELECT * REPLACE (c AS confidence_score, CASE WHEN c < 0.30::DOUBLE THEN 'INFO'
  WHEN vulnerability_type IN ('SQL Injection', 'Command Injection', 'Code Injection') THEN CASE WHEN c >= 0.70::DOUBLE THEN 'CRITICAL' WHEN c >= 0.50::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN vulnerability_type = 'Hardcoded Secret' THEN CASE WHEN c >= 0.80::DOUBLE THEN 'CRITICAL' ELSE 'HIGH' END
  ELSE CASE WHEN c >= 0.75::DOUBLE THEN 'HIGH' WHEN c >= 0.50::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END END AS severity) FROM a)"""


@query(f"WITH {RESCORED_SQL} SELECT emit_seq, confidence_score, severity, {VALUE_OF} AS severity_value FROM rescored")
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rescored(derived_findings(spark, sf_dir)).select("emit_seq", "confidence_score", "severity", "severity_value")


@query(f"WITH {FINDINGS_SQL} SELECT emit_seq, row_number() OVER (ORDER BY severity_value DESC, confidence_score DESC, file_path, coalesce(line_number, 0), rule_id, emit_seq) AS rank FROM findings")
def rank_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ranked(derived_findings(spark, sf_dir), ["emit_seq"]).select("emit_seq", "rank")


@query(f"WITH {FINDINGS_SQL} SELECT {COLUMNS} FROM findings ORDER BY severity_value DESC, confidence_score DESC, emit_seq LIMIT 5")
def top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_findings(spark, sf_dir).orderBy(F.desc("severity_value"), F.desc("confidence_score"), "emit_seq").limit(5)


@query(f"WITH {FINDINGS_SQL} SELECT {COLUMNS} FROM findings QUALIFY row_number() OVER (PARTITION BY file_path, rule_id, line_number ORDER BY emit_seq) = 1")
def dedup_rule_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Line items of one order and number are equal to the SQL's ORDER BY; of these it keeps the first of the table.
    found = derived_findings(spark, sf_dir, F.struct(*PLACE).alias("place"))
    return ops.first_per(found, ["file_path", "rule_id", "line_number"], [F.col("emit_seq"), F.col("place")]).drop("place")


FAMILY_SQL = lambda c: "CASE " + " ".join(f"WHEN contains(upper({c}), '{f}') THEN '{f}'" for f in ops.FAMILIES) + f" ELSE upper({c}) END"


@query(f"""WITH {FINDINGS_SQL} SELECT a.emit_seq, b.emit_seq AS x_emit_seq, CASE WHEN coalesce(upper(trim(a.cwe_id)) = upper(trim(b.cwe_id)), FALSE) OR {FAMILY_SQL('a.rule_id')} = {FAMILY_SQL('b.rule_id')}
  THEN least(1.0::DOUBLE, greatest(a.confidence_score, b.confidence_score) + 0.20::DOUBLE) ELSE greatest(a.confidence_score, b.confidence_score) END AS merged_confidence
FROM findings a JOIN findings b ON a.file_path = b.file_path AND a.vulnerability_type = b.vulnerability_type AND abs(a.line_number - b.line_number) <= 10 WHERE a.engine = 'internal' AND b.engine = 'external'""")
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived_findings(spark, sf_dir)
    return ops.near_pairs(found.where("engine = 'internal'"), found.where("engine = 'external'")).select("emit_seq", "x_emit_seq", "merged_confidence")


@query()
def proximity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merged(derived_findings(spark, sf_dir))


DERIVED_SQL = "CASE WHEN confidence_score >= 0.80::DOUBLE THEN 'HIGH' WHEN confidence_score >= 0.50::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier, CAST(round_even(confidence_score * 100, 0) AS INTEGER) AS confidence_percent, file_path || coalesce(':' || line_number, '') AS location, source IS NOT NULL AND sink IS NOT NULL AS has_taint_flow"


@query(f"WITH {FINDINGS_SQL} SELECT emit_seq, {DERIVED_SQL} FROM findings")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_derived(derived_findings(spark, sf_dir)).select("emit_seq", "confidence_tier", "confidence_percent", "location", "has_taint_flow")


# Roll-ups

COUNTS_SQL = ", ".join(f"coalesce(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END), 0)::BIGINT AS {s.lower()}" for s in ops.RISK) + ", count(*) AS total"
RISK_SQL = "(critical * 10 + high * 5 + medium * 2 + low)::BIGINT"
LEVEL_SQL = f"CASE WHEN critical > 0 OR {RISK_SQL} >= 20 THEN 'CRITICAL' WHEN {RISK_SQL} >= 10 THEN 'HIGH' WHEN {RISK_SQL} >= 3 THEN 'MEDIUM' WHEN {RISK_SQL} >= 1 THEN 'LOW' ELSE 'CLEAR' END"


@query(f"WITH {FINDINGS_SQL}, s AS (SELECT {COUNTS_SQL} FROM findings) SELECT *, {RISK_SQL} AS risk_score, {LEVEL_SQL} AS risk_level FROM s")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(derived_findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL}, s AS (SELECT file_path, {COUNTS_SQL} FROM findings GROUP BY file_path) SELECT *, {RISK_SQL} AS risk_score, {LEVEL_SQL} AS risk_level FROM s")
def risk_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(derived_findings(spark, sf_dir), ["file_path"])


@query(f"WITH {FINDINGS_SQL}, v(severity, severity_value) AS (VALUES {', '.join(f'({quoted(s)}, {v})' for s, v in SEVERITIES.items())}) SELECT v.severity, v.severity_value, count(f.emit_seq) AS n FROM v LEFT JOIN findings f ON f.severity = v.severity GROUP BY 1, 2")
def by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_severity(derived_findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT vulnerability_type, count(*) AS n, count(DISTINCT file_path) AS files, round(avg(confidence_score), 6) AS mean_confidence FROM findings GROUP BY 1")
def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_findings(spark, sf_dir).groupBy("vulnerability_type").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"))


@query(f"WITH {FINDINGS_SQL} SELECT file_path, array_to_string(list_sort(list(DISTINCT vulnerability_type)), ', ') AS types FROM findings GROUP BY file_path")
def types_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.types_by_file(derived_findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL}, {COMPLIANCE_SQL} SELECT emit_seq, framework, control FROM findings LEFT JOIN controls ON cwe = {CWE_NUMBER}")
def compliance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.controls(derived_findings(spark, sf_dir)).select("emit_seq", "framework", "control")


@query(f"WITH {FINDINGS_SQL}, {COMPLIANCE_SQL}, n(framework) AS (VALUES {', '.join(f'({quoted(f)})' for f in FRAMEWORKS)}), c AS (SELECT framework, count(*) AS k FROM findings JOIN controls ON cwe = {CWE_NUMBER} GROUP BY 1) SELECT n.framework, coalesce(k, 0) AS violations, CASE WHEN coalesce(k, 0) > 0 THEN 'Non-Compliant' ELSE 'Compliant' END AS status FROM n LEFT JOIN c USING (framework)")
def compliance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compliance_status(derived_findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT engine, count(DISTINCT file_path) AS files, count(*) AS findings, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(severity_value)] AS max_severity FROM findings GROUP BY engine")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_group(derived_findings(spark, sf_dir), "engine")


@query(f"""WITH {FINDINGS_SQL}, f AS (SELECT file_path, '[' || o_orderpriority || '] ' || file_path AS repo_path, o_orderpriority AS repo, severity_value FROM findings JOIN orders ON file_path = 'src/f' || o_orderkey || '.py')
SELECT repo, count(DISTINCT repo_path) AS files, count(*) AS findings, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(severity_value)] AS max_severity FROM f GROUP BY repo""")
def repo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("src/f"), F.col("o_orderkey"), F.lit(".py")).alias("file_path"), F.col("o_orderpriority").alias("repo"))
    found = derived_findings(spark, sf_dir).join(orders, "file_path")
    return ops.by_group(found.withColumn("file_path", F.concat(F.lit("["), F.col("repo"), F.lit("] "), F.col("file_path"))), "repo")


@query(f"WITH {FINDINGS_SQL} SELECT vulnerability_type, severity, count(*) AS n, grouping(vulnerability_type, severity)::BIGINT AS level FROM findings GROUP BY CUBE (vulnerability_type, severity)")
def severity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_findings(spark, sf_dir).cube("vulnerability_type", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


REGISTRY = [(r.rule_id, "*" if "*" in r.languages or len(r.languages) > 1 else r.languages[0], True) for r in RULES]


@query(f"WITH {FILES_SQL}, r(rule_id, language) AS (VALUES {', '.join(f'({quoted(r.rule_id)}, {quoted(x)})' for r in RULES for x in r.languages)}) SELECT f.language, count(DISTINCT f.file_path) AS files, count(DISTINCT rule_id) AS rules, count(*) AS rules_run FROM files f JOIN r ON r.language = f.language OR r.language = '*' GROUP BY 1")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = F.broadcast(spark.createDataFrame([(r.rule_id, x) for r in RULES for x in r.languages], "rule_id string, r_language string"))  # a row per rule and language
    files = derived_files(spark, sf_dir).withColumn("key", F.explode(F.array(F.col("language"), F.lit("*"))))
    run = files.join(routes, F.col("key") == F.col("r_language"))
    return run.groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.countDistinct("rule_id").alias("rules"), F.count("*").alias("rules_run"))


# Evaluation


@query(f"""WITH {FINDINGS_SQL}, d AS (SELECT file_path, line_number, rule_id, count(*) FILTER (engine = 'internal') AS det, count(*) FILTER (severity_value >= 4) AS exp FROM findings WHERE line_number IS NOT NULL GROUP BY 1, 2, 3)
SELECT file_path, sum(least(det, exp))::BIGINT AS tp, sum(exp - least(det, exp))::BIGINT AS fn, sum(det - least(det, exp))::BIGINT AS fp FROM d WHERE det + exp > 0 GROUP BY 1""")
def eval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived_findings(spark, sf_dir).where("line_number is not null").withColumnRenamed("emit_seq", "seq")
    return ops.evaluated(found.where("severity_value >= 4"), found.where("engine = 'internal'"))


@query(f"""WITH {FINDINGS_SQL}, d AS (SELECT file_path, line_number, rule_id, count(*) FILTER (engine = 'internal') AS det, count(*) FILTER (severity_value >= 4) AS exp FROM findings WHERE line_number IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT file_path, least(det, exp) AS tp, exp - least(det, exp) AS fn, det - least(det, exp) AS fp FROM d WHERE det + exp > 0), s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM e),
c AS (SELECT count(DISTINCT 'src/f' || o_orderkey || '.py') AS tn FROM orders WHERE 'src/f' || o_orderkey || '.py' NOT IN (SELECT file_path FROM e))
SELECT tp, fp, fn, tn, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS tpr, CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END AS fpr, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision FROM s, c""")
def tpr_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("src/f"), F.col("o_orderkey"), F.lit(".py")).alias("file_path"))
    return ops.rates(eval_match(spark, sf_dir), files)


@query(f"WITH {FINDINGS_SQL} SELECT a.emit_seq FROM findings a WHERE a.engine = 'internal' AND EXISTS (SELECT 1 FROM findings b WHERE b.engine = 'external' AND a.file_path = b.file_path AND a.vulnerability_type = b.vulnerability_type AND abs(a.line_number - b.line_number) <= 5)")
def patched_still_vulnerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived_findings(spark, sf_dir)
    return ops.still_vulnerable(found.where("engine = 'internal'"), found.where("engine = 'external'")).select("emit_seq")


@query(f"WITH {FINDINGS_SQL} SELECT b.emit_seq FROM findings b WHERE b.engine = 'external' AND b.severity_value >= 4 AND NOT EXISTS (SELECT 1 FROM findings a WHERE a.engine = 'internal' AND a.file_path = b.file_path AND a.vulnerability_type = b.vulnerability_type AND a.rule_id = b.rule_id AND abs(a.line_number - b.line_number) <= 20)")
def patch_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived_findings(spark, sf_dir)
    return ops.introduced(found.where("engine = 'internal'"), found.where("engine = 'external'")).select("emit_seq")


# Reports


@query(f"WITH {FINDINGS_SQL} SELECT rule_id AS id, replace(vulnerability_type, ' ', '') AS name, vulnerability_type AS short_description, CASE WHEN cwe_id IS NOT NULL THEN 'https://cwe.mitre.org/data/definitions/' || replace(cwe_id, 'CWE-', '') || '.html' END AS help_uri FROM findings GROUP BY rule_id, vulnerability_type, cwe_id")
def sarif_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif_rules(derived_findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT emit_seq, sha256(CASE WHEN coalesce(code_snippet, '') <> '' THEN code_snippet ELSE rule_id || ':' || file_path || ':' || coalesce(CAST(line_number AS VARCHAR), 'None') END) AS fingerprint FROM findings")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_findings(spark, sf_dir).select("emit_seq", ops.fingerprint().alias("fingerprint"))


@query(f"""SELECT rule_id, level, file_path AS uri, line_number AS start_line, fingerprint, CAST(json_object('ruleId', rule_id, 'level', level, 'message', json_object('text', vulnerability_type),
  'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file_path, 'uriBaseId', '%SRCROOT%'), 'region', json_object('startLine', line_number)))),
  'partialFingerprints', json_object('primaryLocationLineHash', fingerprint)) AS VARCHAR) AS result
FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'note' ELSE 'warning' END AS level,
  sha256(CASE WHEN coalesce(code_snippet, '') <> '' THEN code_snippet ELSE rule_id || ':' || file_path || ':' || coalesce(CAST(line_number AS VARCHAR), 'None') END) AS fingerprint FROM ({SCAN_SQL}))""")
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif_results(scan(derived_files(spark, sf_dir)))


FLOWS_SQL = f"""SELECT f.*, CAST(CASE WHEN coalesce(f.source, '') = '' THEN f.line_number ELSE coalesce(list_max(list_filter(range(greatest(1, f.line_number - 11), least(len(files.lines), f.line_number - 1) + 1), lambda i: contains(files.lines[i], f.source))), greatest(1, f.line_number - 1)) END AS INTEGER) AS source_line
FROM ({SCAN_SQL}) f JOIN (WITH {FILES_SQL} SELECT file_path, lines FROM files) files USING (file_path)"""


def _step_sql(line: str, column: str, text: str, otherwise: str) -> str:
    said = f"CASE WHEN coalesce({column}, '') = '' THEN '{otherwise}' ELSE '{text} ''' || {column} || '''' END"
    return f"""json_object('location', json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file_path, 'uriBaseId', '%SRCROOT%'), 'region', json_object('startLine', {line})), 'message', json_object('text', {said})), 'importance', 'essential')"""


@query(f"""SELECT file_path, line_number, rule_id, source_line, CAST(json_object('codeFlows', json_array(json_object('threadFlows', json_array(json_object('locations', json_array(
{_step_sql('source_line', 'source', 'Taint source: variable/input', 'Taint source: dynamic user input')},
{_step_sql('line_number', 'sink', 'Taint sink: execution flow reaches', 'Taint sink: vulnerability execution site')})))))) AS VARCHAR) AS flow FROM ({FLOWS_SQL})""")
def sarif_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived_files(spark, sf_dir)
    flows = with_flows(cut(scan(files), "scanned"), files)
    return flows.select("file_path", "line_number", "rule_id", "source_line", F.to_json(F.struct(code_flow(F.col("source_line")).alias("codeFlows"))).alias("flow"))


@query(f"""WITH f AS ({SCAN_SQL}), n AS (SELECT count(*) AS results, count(DISTINCT rule_id) AS rules FROM f), s(section) AS (VALUES (0), (1), (2), (3), (4))
SELECT CAST(section AS INTEGER) AS section, CASE section WHEN 1 THEN rules WHEN 3 THEN results ELSE 1 END AS lines, CASE section WHEN 1 THEN rules - 1 WHEN 3 THEN results - 1 ELSE 0 END AS commas FROM n, s""")
def sarif_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived_files(spark, sf_dir)
    document = run_document(cut(scan(files), "scanned"), files)
    return document.groupBy("section").agg(F.count("*").alias("lines"), F.count_if(F.col("text").startswith(",")).alias("commas"))


def _controls_sql() -> str:
    """The compliance map of a finding's CWE as JSON text."""
    maps: dict[str, dict[str, str]] = {}
    for cwe, framework, control in rows():
        maps.setdefault(cwe, {})[framework] = control
    return f"CASE {CWE_NUMBER} " + " ".join(f"WHEN {quoted(c)} THEN {quoted(json.dumps(m, separators=(',', ':'), ensure_ascii=False))}" for c, m in maps.items()) + " ELSE '{}' END"


_JSON_FIELDS = [*[c.strip() for c in COLUMNS.split(",")], "confidence_tier", "confidence_percent", "location", "has_taint_flow"]


@query(f"""WITH {FINDINGS_SQL}, d AS (SELECT *, {DERIVED_SQL} FROM findings),
p AS (SELECT [{', '.join(f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || CAST(to_json({c}) AS VARCHAR) END" for c in _JSON_FIELDS)},
  '"compliance":' || {_controls_sql()}, '"vulnerability":' || CAST(to_json(vulnerability_type) AS VARCHAR), '"confidence":' || confidence_percent] AS parts FROM d)
SELECT '{{' || array_to_string(list_filter(parts, lambda x: x IS NOT NULL), ',') || '}}' AS value FROM p""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(derived_findings(spark, sf_dir))


@query(f"""WITH RECURSIVE {FILES_SQL}, {rule_ctes(BY_ID['PY-SQLI-001'])},
s AS (SELECT file_path, lines, line_number, 'user_input' AS source FROM sites)
SELECT file_path, CAST(line_number AS INTEGER) AS line_number, CAST(coalesce(list_max(list_filter(range(greatest(1, line_number - 11), least(len(lines), line_number - 1) + 1), lambda i: contains(lines[i], source))), greatest(1, line_number - 1)) AS INTEGER) AS source_line FROM s""")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = sink_sites(derived_files(spark, sf_dir), [BY_ID["PY-SQLI-001"]])
    return sites.select("file_path", "line_number", ops.source_line(F.col("lines"), F.col("line_number"), F.lit("user_input")).alias("source_line"))


# Auditors' reports, written from the tables and read back


@query("""SELECT 's' || s_nationkey || '/requirements.txt' AS file_path, 'SCA-' || vid AS rule_id, s_name || '==' || s_suppkey AS code_snippet,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Upgrade ' || s_name || ' to the latest secure version.' ELSE 'Upgrade ' || s_name || ' to one of: ' || s_suppkey || '.1, ' || s_suppkey || '.2' END AS recommendation, 0.9::DOUBLE AS confidence_score, 'CWE-1104' AS cwe_id
FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'GHSA-' || s_suppkey ELSE 'PYSEC-' || s_suppkey END AS vid FROM supplier)""")
def sca_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    vid = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "GHSA-").otherwise("PYSEC-"), key)
    fixes = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(key, F.lit(".1")), F.concat(key, F.lit(".2"))))
    item = F.struct(F.col("s_name").alias("name"), key.alias("version"), F.array(F.struct(vid.alias("id"), F.lit("d").alias("description"), fixes.alias("fix_versions"))).alias("vulns"))
    report = F.when(F.col("s_suppkey") % 5 == 0, F.to_json(F.array(item))).otherwise(F.to_json(F.struct(F.array(item).alias("dependencies"))))
    reports = s.select(F.concat(F.lit("s"), F.col("s_nationkey"), F.lit("/requirements.txt")).alias("file_path"), report.alias("report"))
    return python_audit(reports).select("file_path", "rule_id", "code_snippet", "recommendation", "confidence_score", "cwe_id")


@query("""WITH p AS (SELECT *, 'pkg' || p_partkey AS pkg, CASE p_size % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' ELSE 'HIGH' END AS sev FROM part)
SELECT 'package.json' AS file_path, 'SCA-NPM-' || pkg AS rule_id, sev AS severity, 0.9::DOUBLE AS confidence_score, 'CWE-' || p_size AS cwe_id, '"' || pkg || '": "<' || p_size || '"' AS code_snippet, 'Upgrade ' || pkg || ' to version ' || p_size || '.0.' AS recommendation FROM p
UNION ALL SELECT 'package.json', 'SCA-NPM-' || pkg, sev, 0.8::DOUBLE, 'CWE-1104', '"' || pkg || '" via parent "' || p_brand || '"', 'Upgrade dependency ' || pkg || ' or parent dependency ' || p_brand || '.' FROM p""")
def sca_npm_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size, pkg = F.col("p_size").cast("string"), F.concat(F.lit("pkg"), F.col("p_partkey"))
    severity = F.when(F.col("p_size") % 3 == 0, "critical").when(F.col("p_size") % 3 == 1, "low").otherwise("weird")
    via = F.concat(F.lit('[{"title":"t","cwe":["CWE-'), size, F.lit('"]},"'), F.col("p_brand"), F.lit('"]'))
    body = F.concat(F.lit('{"severity":"'), severity, F.lit('","via":'), via, F.lit(',"range":"<'), size, F.lit('","fixAvailable":{"version":"'), size, F.lit('.0"}}'))
    reports = p.select(F.lit("package.json").alias("file_path"), F.concat(F.lit('{"auditReportVersion":2,"vulnerabilities":{"'), pkg, F.lit('":'), body, F.lit("}}")).alias("report"))
    return npm_audit(reports).select("file_path", "rule_id", "severity", "confidence_score", "cwe_id", "code_snippet", "recommendation")


@query("""SELECT 'package-lock.json' AS file_path, 'SCA-NPM-' || p_name AS rule_id, CASE WHEN p_size % 2 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, 'CWE-' || p_size AS cwe_id, '"' || p_name || '": "' || p_size || '.1"' AS code_snippet, 'Upgrade ' || p_name || ' to version >=' || p_size || '. (t)' AS recommendation FROM part""")
def sca_npm_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("string")
    advisory = F.struct(F.col("p_name").alias("module_name"), F.when(F.col("p_size") % 2 == 0, "medium").alias("severity"), F.lit("t").alias("title"), F.concat(F.lit("CWE-"), size).alias("cwe"), F.concat(F.lit(">="), size).alias("patched_versions"), F.array(F.struct(F.concat(size, F.lit(".1")).alias("version"))).alias("findings"))
    reports = p.select(F.lit("package-lock.json").alias("file_path"), F.to_json(F.struct(F.create_map(F.col("p_partkey").cast("string"), advisory).alias("advisories"))).alias("report"))
    return npm_audit(reports).select("file_path", "rule_id", "severity", "cwe_id", "code_snippet", "recommendation")


@query("""SELECT 'app/f' || l_orderkey || '.py' AS file_path, CAST(l_partkey % 60 + 1 AS INTEGER) AS line_number, 'EXT-' || upper(id) AS rule_id, ['SQL Injection', 'Command Injection', 'Hardcoded Secret', 'Unknown'][l_linenumber % 4 + 1] AS vulnerability_type,
  CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN l_linestatus = 'O' THEN 0.85::DOUBLE ELSE 0.40::DOUBLE END AS confidence_score, ['CWE-89', 'CWE-78', 'CWE-798', 'CWE-1'][l_linenumber % 4 + 1] AS cwe_id
FROM (SELECT *, ['py.sqli-x', 'cmd-y', 'my-secret', 'other'][l_linenumber % 4 + 1] AS id FROM lineitem)""")
def external_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = F.col("l_linenumber") % 4
    check = F.get(F.array(*[F.lit(x) for x in ("py.sqli-x", "cmd-y", "my-secret", "other")]), at)
    meta = F.struct(F.when(F.col("l_linestatus") == "O", "high").otherwise("low").alias("confidence"), F.when(at == 3, F.array(F.lit("CWE-1"))).alias("cwe"))
    extra = F.struct(F.lit(" x ").alias("lines"), F.lit("m").alias("message"), F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info").alias("severity"), meta.alias("metadata"))
    result = F.struct(check.alias("check_id"), F.concat(F.lit("app/f"), F.col("l_orderkey"), F.lit(".py")).alias("path"), F.struct((F.col("l_partkey") % 60 + 1).alias("line")).alias("start"), extra.alias("extra"))
    reports = items.select(F.to_json(F.struct(F.array(result).alias("results"))).alias("report"))
    return pattern_report(reports).select("file_path", "line_number", "rule_id", "vulnerability_type", "severity", "confidence_score", "cwe_id")


# Syntax trees and the call graph


@query()
def ast_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ast_findings(derived_files(spark, sf_dir))


def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of a call graph: order k defines step_k, which passes its second parameter on to step_(k+1) up to every seventh,
    where it runs a query; and a handler that calls step_k with request data."""
    keys = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")))
    step = F.when(F.col("k") % 7 == 0, F.lit("    db.execute('SELECT ' + b)")).otherwise(F.concat(F.lit("    step_"), F.col("k") + 1, F.lit("(a, b)")))
    lines = F.array(F.concat(F.lit("def step_"), F.col("k"), F.lit("(a, b):")), step, F.lit("def handle():"), F.lit("    q = request.args"), F.concat(F.lit("    step_"), F.col("k"), F.lit("(1, q)")))
    return keys.select(F.concat(F.lit("app/m"), F.col("k"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), lines.alias("lines"))


REACH_SQL = """orders_k AS (SELECT DISTINCT o_orderkey AS k FROM orders),
reach AS (SELECT k FROM orders_k WHERE k % 7 = 0 UNION SELECT o.k FROM orders_k o JOIN reach r ON o.k + 1 = r.k WHERE o.k % 7 <> 0)"""


@query(f"WITH RECURSIVE {REACH_SQL} SELECT 'step_' || k AS name, 1::INTEGER AS param, 'SQL Injection' AS type FROM reach")
def callgraph_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink_parameters(functions_of(call_files(spark, sf_dir)))


@query(f"WITH RECURSIVE {REACH_SQL} SELECT 'app/m' || k || '.py' AS file_path, 5::INTEGER AS line_number, 'TAINT-CROSS-FILE-001' AS rule_id, 'SQL Injection' AS vulnerability_type, 'request.args' AS source, 'Call to step_' || k || '() passing tainted arg ''q'' to sink param ''b''' AS sink FROM reach")
def taint_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_line(taint_findings(call_files(spark, sf_dir))).select("file_path", "line_number", "rule_id", "vulnerability_type", "source", "sink")


def returning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules where order k defines pass_k, which gives its argument back through pass_(k+1) or, every third, a constant; and a
    handler that sends request data through pass_k on to a query."""
    keys = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")))
    body = F.when(F.col("k") % 3 == 0, F.lit("    return 1")).otherwise(F.concat(F.lit("    c = pass_"), F.col("k") + 1, F.lit("(b)")))
    back = F.when(F.col("k") % 3 == 0, F.lit("    pass")).otherwise(F.lit("    return c"))
    call = F.concat(F.lit("    q = pass_"), F.col("k"), F.lit("(request.args)"))
    run = F.lit("def run_it(sql):"), F.lit("    db.execute('SELECT ' + sql)")
    lines = F.array(*run, F.concat(F.lit("def pass_"), F.col("k"), F.lit("(b):")), body, back, F.lit("def handle():"), call, F.lit("    r = q"), F.lit("    run_it(r)"))
    return keys.select(F.concat(F.lit("app/m"), F.col("k"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), lines.alias("lines"))


@query("""SELECT 'app/m' || o_orderkey || '.py' AS file_path, 9::INTEGER AS line_number, 'SQL Injection' AS vulnerability_type,
  CASE WHEN o_orderkey % 3 = 0 THEN 'pass_' || o_orderkey || '(request.args)' ELSE 'request.args' END AS source, 'Call to run_it() passing tainted arg ''r'' to sink param ''sql''' AS sink FROM orders""")
def taint_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_line(taint_findings(returning_files(spark, sf_dir))).select("file_path", "line_number", "vulnerability_type", "source", "sink")


# Watching


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderdate AS m FROM orders WHERE o_orderkey % 11 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS m FROM orders WHERE o_orderkey % 13 <> 0)
SELECT 'src/f' || coalesce(b.k, n.k) AS file_path, CASE WHEN b.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN n ON b.k = n.k WHERE b.k IS NULL OR n.k IS NULL OR n.m > b.m""")
def watch_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("src/f"), F.col("o_orderkey")).alias("file_path"), F.col("o_orderdate").alias("mtime"))
    now = o.where("o_orderkey % 13 <> 0").withColumn("mtime", F.when(F.col("o_orderkey") % 5 == 0, F.col("mtime") + F.expr("interval 1 day")).otherwise(F.col("mtime")))
    return snapshot_changes(o.where("o_orderkey % 11 <> 0"), now)


@query("SELECT conv_id AS uri, max(turn) AS version, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_buffers(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("uri"), F.col("turn").alias("version"), "text"))


@query("""WITH e AS (SELECT event_id, event_type, user_id, event_id % 4 AS a FROM events) SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_changed FROM e
WHERE (event_type = 'click' AND event_id % 3 <> 0 AND user_id % 5 <> 0) OR (event_type = 'view' AND a < 3)""")
def webhook_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), F.col("user_id"))))
    commits = F.array(F.struct(files.alias("added"), files.alias("modified")), F.struct(files.alias("added"), files.alias("modified")))
    events = e.select(
        "event_id", F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "view", "pull_request").alias("kind"),
        F.get(F.array(*[F.lit(x) for x in ("opened", "synchronize", "reopened", "closed")]), (F.col("event_id") % 4).cast("int")).alias("action"),
        F.when(F.col("user_id") % 5 == 0, "fix/x").otherwise("main").alias("branch"), commits.alias("commits"),
    )
    return scan_jobs(events).select("event_id", F.size("changed").alias("n_changed"))


SECRET = b"a shared secret"


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries from events: clicks are pushes, views pull requests, others pings; every tenth has a wrong signature, every
    thirteenth a body that is cut off, and every fourth comes twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), F.col("user_id"), F.lit(".py"))))
    head = F.struct(F.concat(F.lit("b"), F.col("user_id")).alias("ref"), F.sha1(F.col("event_id").cast("string").cast("binary")).alias("sha"))
    action = F.get(F.array(*[F.lit(x) for x in ("opened", "synchronize", "reopened", "closed")]), (F.col("event_id") % 4).cast("int"))
    ref = F.when(F.col("user_id") % 5 == 0, "refs/heads/fix/x").otherwise("refs/heads/main")
    body = F.to_json(F.struct(action.alias("action"), ref.alias("ref"), F.sha1(F.col("event_id").cast("string").cast("binary")).alias("after"), F.array(F.struct(names.alias("added"), names.alias("modified"))).alias("commits"),
                              F.struct(F.concat(F.lit("o/r"), F.col("user_id") % 50).alias("full_name")).alias("repository"), F.struct(F.col("event_id").alias("number"), head.alias("head")).alias("pull_request")))
    body = F.when(F.col("event_id") % 13 == 0, F.left(body, F.lit(20))).otherwise(body)
    signature = F.concat(F.lit("sha256="), hmac_sha256(SECRET, F.when(F.col("delivery_id") % 10 == 0, F.lit("x")).otherwise(F.col("body")).cast("binary")))
    kind = F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "view", "pull_request").otherwise("ping")
    rows = e.select(F.col("event_id").alias("delivery_id"), kind.alias("event"), body.alias("body"), F.col("ts").cast("timestamp").alias("received_at")).withColumn("signature", signature)
    return rows.unionByName(rows.where("delivery_id % 4 = 0"))


DELIVERIES_SQL = """d AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'push' WHEN 'view' THEN 'pull_request' ELSE 'ping' END AS kind,
  event_id % 10 <> 0 AS signed, event_id % 13 <> 0 AS whole, user_id % 5 = 0 AS fix, event_id % 3 <> 0 AS changes, event_id % 4 < 3 AS acts FROM events),
j AS (SELECT *, signed AND whole AND ((kind = 'push' AND changes AND NOT fix) OR (kind = 'pull_request' AND acts)) AS job FROM d)"""


@query(f"""WITH {DELIVERIES_SQL} SELECT event_id AS job_id, 'o/r' || user_id % 50 AS repo_name, CASE WHEN kind = 'push' THEN 'main' ELSE 'b' || user_id END AS branch, sha1(CAST(event_id AS VARCHAR)) AS commit_sha,
  CASE WHEN kind = 'push' THEN 'f' || user_id || '.py' ELSE '' END AS changed, event_id AS pr_number FROM j WHERE job""")
def signed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queued_jobs(deliveries(spark, sf_dir), SECRET).select("job_id", "repo_name", "branch", "commit_sha", F.array_join("changed", ",").alias("changed"), "pr_number")


@query(f"""WITH {DELIVERIES_SQL}, a AS (SELECT CAST(CASE WHEN NOT signed THEN 401 WHEN NOT whole THEN 400 WHEN job THEN 202 ELSE 200 END AS INTEGER) AS answer, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS times FROM j)
SELECT answer, CAST(sum(times) AS BIGINT) AS n FROM a GROUP BY answer""")
def webhook_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(deliveries(spark, sf_dir), SECRET).groupBy("answer").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT 'u' || user_id AS job_id, ts AS t, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status FROM events WHERE value < 60),
f AS (SELECT job_id, min(t) FILTER (status = 'queued') AS queued_at, min(t) FILTER (status = 'running') AS started_at, min(t) FILTER (status IN ('done', 'failed')) AS completed_at FROM e WHERE status IS NOT NULL GROUP BY job_id)
SELECT job_id, coalesce((SELECT min(e.status) FROM e WHERE e.job_id = f.job_id AND e.t = f.completed_at AND e.status IN ('done', 'failed')), CASE WHEN started_at IS NOT NULL THEN 'running' ELSE 'queued' END) AS status, queued_at, started_at, completed_at FROM f""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value < 60")
    status = F.when(F.col("event_type").isin("signup", "view"), "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    return job_registry(e.select(F.concat(F.lit("u"), F.col("user_id")).alias("job_id"), F.col("ts").alias("at"), status.alias("status")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return events.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(f"""SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS seen, {strip_sql("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")} AS before FROM conversations""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", "role", F.count("*").over(order).alias("seen"), strip(F.lag("text").over(order)).alias("before"))
