"""Registered queries on patches, user's rules, advice and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import split_lines
from tracewell.operators.catalogue import RULES
from tracewell.operators.cut import cut
from tracewell.operators.findings import organisation_totals, still_vulnerable
from tracewell.operators.patch import REWRITERS, patched
from tracewell.operators.registry import Registry, recommendation, registry_stats
from tracewell.operators.repair import patched_to_rest
from tracewell.operators.rulespec import Match, Rule, quoted
from tracewell.operators.scan import scan
from tracewell.plans.corpus import FILES_SQL, derived_files
from tracewell.plans.oracle import rule_sql
from tracewell.plans.tables import FINDINGS_SQL, derived_findings
from tracewell.streaming.notify import chat_message, mail_lines, tickets

#: Rules as a user may add them; the second is switched off.
OWN_RULES = (
    Rule("ORG-VALUE-001", ("python", "java"), r"\b(?:value_|int v)\d+ = ", "Unknown", "LOW", "CWE-1106", "literal", ((0.4, Match("line", r"= \d+")), (0.2, Match("w", r"\d{2}"))), after=2, threshold=0.6),
    Rule("ORG-VALUE-002", ("*",), r"=", "Unknown", "INFO", "", "", ((1.0, Match("line", "=")),), enabled=False),
)
PATCHED_RULES = [r.rule_id for r in RULES if r.kind in {kind for kind, _ in REWRITERS} and {"python", "java", "*"} & {*r.languages}]


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = derived_files(spark, sf_dir)
    findings = scan(files, PATCHED_RULES)
    return findings, patched(files.select("file_path", F.array_join("lines", "\n").alias("code")), findings)


def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched code of every file with findings that could be rewritten."""
    found = _patched(spark, sf_dir)[1].where(F.size("changed_lines") > 0)
    return found.select("file_path", "patched", "summary", F.array_join("changed_lines", ",").alias("changed_lines"))


def patch_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a scan of the patched code shows again near their line."""
    findings, done = _patched(spark, sf_dir)
    after = cut(done.where(F.size("changed_lines") > 0).select("file_path", F.col("patched").alias("code")), "patched")
    language = F.when(F.endswith("file_path", F.lit(".py")), "python").otherwise("java")
    rescan = scan(after.select("file_path", language.alias("language"), split_lines(F.col("code")).alias("lines")), PATCHED_RULES)
    return still_vulnerable(findings, rescan).select("file_path", "line_number", "rule_id", "vulnerability_type")


def patch_to_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with findings, patched and scanned again as long as findings become fewer."""
    rest = patched_to_rest(derived_files(spark, sf_dir).where(F.col("language").isin("python", "java")), PATCHED_RULES)
    return rest.where("rounds > 0 or findings > 0").select("file_path", F.array_join("lines", "\n").alias("code"), "rounds", "findings", "reason")


def own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by user's rules; the one that is switched off finds nothing."""
    return scan(derived_files(spark, sf_dir), [r.rule_id for r in OWN_RULES], catalogue=OWN_RULES)


def rules_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each language with the number of rules, enabled and not, that apply to it."""
    rules = Registry([*RULES, *OWN_RULES]).frame(spark)
    files = derived_files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"))
    applies = F.broadcast(rules.withColumnRenamed("language", "for"))  # a row per rule and language
    out = files.join(applies, (F.col("for") == F.col("language")) | (F.col("for") == "*"), "left").groupBy("language", "files")
    return out.agg(F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice by type and reference, with the number of findings it is given for."""
    text = recommendation(F.col("vulnerability_type"), F.trim(F.upper("cwe_id")))
    return derived_findings(spark, sf_dir).groupBy(text.alias("recommendation")).agg(F.count("*").alias("n"))


def org_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories scanned and failed, of results derived from orders."""
    status = F.element_at(F.create_map(*map(F.lit, ("F", "scanned", "O", "clone_failed", "P", "error"))), F.col("o_orderstatus"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return organisation_totals(orders.select(F.col("o_orderpriority").alias("organisation"), F.col("o_orderkey").alias("repository"), status.alias("status")))


def ticket_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket for each severe finding."""
    return tickets(derived_findings(spark, sf_dir), "SEC")


def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the registry, beside the number of files that it is for."""
    files = derived_files(spark, sf_dir).groupBy("language").count().agg(F.sum("count").alias("files"), F.count("*").alias("file_languages"))
    return registry_stats(Registry([*RULES, *OWN_RULES]).frame(spark)).crossJoin(files)  # one row each


def mail_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings by rank as lines of a mail."""
    return mail_lines(derived_findings(spark, sf_dir))


def chat_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message on a scan with its first findings."""
    return chat_message(derived_findings(spark, sf_dir), "src")


_RULES_SQL = "rules(rule_id, lang, enabled) AS (VALUES " + ", ".join(f"({quoted(r.rule_id)}, {quoted(x)}, {str(r.enabled).lower()})" for r in (*RULES, *OWN_RULES) for x in r.languages) + ")"
_ORDER = "ORDER BY severity_value DESC, confidence_score DESC, file_path, coalesce(line_number, 0), rule_id"
QUERIES = {q.__name__: q for q in (patch_lines, patch_rescan, patch_to_rest, own_rules, rules_by_language, recommendations, org_totals, ticket_payloads, registry_summary, mail_body, chat_payload)}
ORACLES = {
    "own_rules": rule_sql(OWN_RULES[0]),
    "rules_by_language": f"""WITH {FILES_SQL}, {_RULES_SQL}, n AS (SELECT language, count(*) AS files FROM files GROUP BY language)
SELECT language, files, count_if(enabled) AS enabled, count_if(NOT enabled) AS disabled FROM n LEFT JOIN rules ON lang = language OR lang = '*' GROUP BY language, files""",
    "org_totals": """SELECT o_orderpriority AS organisation, count_if(o_orderstatus = 'F') AS scanned, count_if(o_orderstatus IN ('O', 'P')) AS failed FROM orders GROUP BY 1""",
    "ticket_payloads": f"""WITH {FINDINGS_SQL} SELECT file_path, line_number, rule_id, CAST(json_object('fields', json_object('project', json_object('key', 'SEC'),
'summary', '[' || severity || '] Security Finding: ' || vulnerability_type || ' in ' || file_path,
'description', 'A ' || severity || ' vulnerability was found.' || chr(10) || chr(10) || '*Type:* ' || vulnerability_type || chr(10) || '*Rule ID:* ' || rule_id || chr(10) || '*CWE:* ' || coalesce(cwe_id, 'N/A') || chr(10)
|| '*File:* ' || file_path || chr(10) || '*Line:* ' || coalesce(CAST(line_number AS VARCHAR), 'N/A') || chr(10) || chr(10) || '*Recommendation:*' || chr(10) || 'Review the ' || vulnerability_type
|| ' vulnerability at the flagged location and apply appropriate sanitisation or safe API usage. Refer to: ' || coalesce(nullif(cwe_id, ''), 'OWASP Top 10') || '.',
'issuetype', json_object('name', 'Bug'))) AS VARCHAR) AS payload FROM findings WHERE severity_value >= 4""",
    "recommendations": f"""WITH {FINDINGS_SQL} SELECT 'Review the ' || vulnerability_type || ' vulnerability at the flagged location and apply appropriate sanitisation or safe API usage. Refer to: '
|| coalesce(nullif(trim(upper(cwe_id)), ''), 'OWASP Top 10') || '.' AS recommendation, count(*) AS n FROM findings GROUP BY 1""",
    "registry_summary": f"""WITH {FILES_SQL}, {_RULES_SQL}, n AS (SELECT count(*) AS files, count(DISTINCT language) AS file_languages FROM files)
SELECT count(DISTINCT rule_id) AS total, count(DISTINCT rule_id) FILTER (enabled) AS enabled, count(DISTINCT rule_id) FILTER (NOT enabled) AS disabled,
  array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages, any_value(files) AS files, any_value(file_languages) AS file_languages FROM rules, n""",
    "mail_body": f"""WITH {FINDINGS_SQL}, r AS (SELECT *, row_number() OVER ({_ORDER}) AS rank FROM findings)
SELECT rank, rank || '. [' || severity || '] ' || vulnerability_type || ' at ' || file_path || coalesce(':' || line_number, '') || chr(10) || '   Remediation: Review the ' || vulnerability_type
|| ' vulnerability at the flagged location and apply appropriate sanitisation or safe API usage. Refer to: ' || coalesce(nullif(cwe_id, ''), 'OWASP Top 10') || '.' AS text FROM r""",
    "chat_payload": f"""WITH {FINDINGS_SQL}, r AS (SELECT *, row_number() OVER ({_ORDER}) AS k FROM findings),
t AS (SELECT string_agg(k || '. *[' || severity || ']* ' || vulnerability_type || ' at `' || file_path || coalesce(':' || line_number, '') || '`', chr(10) ORDER BY k) AS top FROM r WHERE k <= 5),
n AS (SELECT count_if(severity = 'CRITICAL') AS c, count_if(severity = 'HIGH') AS h, count_if(severity = 'MEDIUM') AS m, count_if(severity = 'LOW') AS l, count(*) AS total FROM findings),
s AS (SELECT *, c * 10 + h * 5 + m * 2 + l AS score FROM n)
SELECT CAST(json_object('blocks', json_array(
  json_object('type', 'header', 'text', json_object('type', 'plain_text', 'text', 'Security Scan Report')),
  json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text', '*Target:* `src`' || chr(10) || '*Scanner:* `rules`' || chr(10) || '*Risk Level:* *'
    || CASE WHEN c > 0 OR score >= 20 THEN 'CRITICAL' WHEN score >= 10 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'CLEAR' END || '* (Score: ' || score || ')')),
  json_object('type', 'section', 'fields', json_array(json_object('type', 'mrkdwn', 'text', '*Critical:* ' || c), json_object('type', 'mrkdwn', 'text', '*High:* ' || h),
    json_object('type', 'mrkdwn', 'text', '*Medium:* ' || m), json_object('type', 'mrkdwn', 'text', '*Low:* ' || l))),
  json_object('type', 'divider'),
  json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text', '*Top Findings:*' || chr(10) || top || chr(10) || '...and ' || (total - 5) || ' more.')))) AS VARCHAR) AS payload FROM s, t""",
}
