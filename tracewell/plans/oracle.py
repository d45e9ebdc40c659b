"""DuckDB SQL of the rules, for comparison with the Spark scan over the derived files."""

from __future__ import annotations

import re

from tracewell.operators.catalogue import DKR_002, LAST_USER, OPEN_PORT, PUBLIC_ACL, USER_INPUT
from tracewell.operators.rulespec import SEVERITIES, Rule, quoted
from tracewell.operators.scan import NOT_FOLLOWED, REACH
from tracewell.plans.corpus import FILES_SQL

SPACE = r"^\s+|\s+$"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {quoted(SPACE)}, '', 'g')"


COMMENT = f"""({strip_sql('line')} = '' OR (language IN ('python', 'php') AND starts_with({strip_sql('line')}, '#'))
  OR (language IN ('java', 'go', 'php', 'javascript', 'typescript') AND regexp_matches({strip_sql('line')}, '^(//|/\\*|\\*)')))"""


def _snippets(rule: Rule) -> str:
    parts = []
    for pattern, ignore_case in rule.snippets:
        text = quoted(f"(?i){pattern}" if ignore_case else pattern)
        groups = re.compile(pattern).groups
        if groups == 2:
            parts.append(f"list_transform(list_zip(regexp_extract_all(w, {text}, 1), regexp_extract_all(w, {text}, 2)), lambda s: CASE WHEN s[1] <> '' THEN s[1] ELSE s[2] END)")
        elif groups == 1:
            parts.append(f"list_filter(list_transform(regexp_extract_all(w, {text}, 1), lambda x: {strip_sql('x')}), lambda x: NOT regexp_matches(x, '^[\"'']'))")
        else:
            parts.append(f"regexp_extract_all(w, {text}, 0)")
    return " || ".join(parts)


def _source(rule: Rule) -> str:
    if rule.source_when is not None:
        return f"CASE WHEN {rule.source_when[0].sql()} THEN {quoted(rule.source_when[1])} ELSE {quoted(rule.source)} END"
    if not rule.snippets:
        return quoted(rule.source) if rule.source else "CAST(NULL AS VARCHAR)"
    found = _snippets(rule)
    return f"coalesce(list_filter(list_transform({found}, lambda x: {strip_sql('x')}), lambda x: x <> '' AND regexp_matches(x, {quoted('(?i)' + USER_INPUT)}))[1], {strip_sql(f'({found})[1]')})"


def _sink(rule: Rule) -> str:
    if rule.sink_text == "match":
        return f"left({strip_sql('sink')}, 80)"
    if rule.sink_text == "line":
        return strip_sql("line")
    if rule.sink_text == "port":
        first = f"regexp_extract(w, {quoted(f'(?m)^.*{OPEN_PORT}.*$')}, 0)"
        return f"'Wide-open access to ' || CASE WHEN contains({first}, '22') THEN 'SSH (22)' WHEN contains({first}, '3389') THEN 'RDP (3389)' ELSE 'All Ports (0)' END || ' configured in ingress rules'"
    if rule.sink_text == "acl":
        return f"'Bucket access ACL set to public: ''' || regexp_extract(line, {quoted('(?i)' + PUBLIC_ACL)}, 1) || ''''"
    return quoted(rule.sink_text)


def rule_ctes(rule: Rule) -> str:
    """CTEs ``sites`` and ``scored`` of one rule, after ``files``."""
    language = "TRUE" if "*" in rule.languages else f"language IN ({', '.join(quoted(x) for x in rule.languages)})"
    first = f"regexp_extract(line, {quoted(rule.regex)}, 0)"
    found = f"regexp_matches(line, {quoted(rule.regex)})"
    if rule.also is not None:
        second = quoted("(?i)" + rule.also)
        first = f"CASE WHEN {first} <> '' THEN {first} ELSE regexp_extract(line, {second}, 0) END"
        found = f"({found} OR regexp_matches(line, {second}))"
    skip = f" AND NOT {COMMENT}" if rule.skip_comments else ""
    window = f"array_to_string(lines[greatest(1, line_number - {rule.before}):least(len(lines), line_number - 1 + {rule.after})], chr(10))"
    sites = f"""numbered AS (SELECT file_path, language, lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_number FROM files WHERE {language}),
sites AS (SELECT *, {first} AS sink, {window} AS near FROM numbered WHERE {found}{skip})"""
    if rule.backtrack is None:
        return f"{sites}, windows AS (SELECT *, near AS w FROM sites)"
    words = ", ".join(quoted(x) for x in NOT_FOLLOWED)
    return f"""{sites},
walk AS (
  SELECT file_path, line_number, lines, line_number - 1 AS pos, [regexp_extract(line, {quoted(rule.backtrack)}, 1)] AS names, CAST([] AS VARCHAR[]) AS found
  FROM sites WHERE regexp_extract(line, {quoted(rule.backtrack)}, 1) <> ''
  UNION ALL
  SELECT file_path, line_number, lines, pos - 1,
    CASE WHEN hit IS NULL THEN names ELSE names || list_filter(list_distinct(words), lambda x: NOT list_contains(names, x)) END,
    CASE WHEN hit IS NOT NULL AND pos < line_number - {rule.before} THEN [above] || found ELSE found END
  FROM (SELECT *, list_filter(regexp_extract_all(regexp_extract(above, '\\b' || hit || '\\s*(\\+?=)\\s*(.*)', 2), '\\b([a-zA-Z_]\\w*)\\b', 1), lambda x: x NOT IN ({words})) AS words
    FROM (SELECT *, CASE WHEN regexp_matches({strip_sql('above')}, '^(#|//|\\*)') OR {strip_sql('above')} = '' THEN NULL
        ELSE list_filter(names, lambda v: regexp_matches(above, '\\b' || v || '\\s*\\+?='))[1] END AS hit
      FROM (SELECT *, lines[pos] AS above FROM walk WHERE pos >= greatest(1, line_number - {REACH}))))),
ended AS (SELECT file_path, line_number, found FROM walk WHERE pos < greatest(1, line_number - {REACH})),
windows AS (SELECT s.*, array_to_string(coalesce(e.found, CAST([] AS VARCHAR[])) || [near], chr(10)) AS w FROM sites s LEFT JOIN ended e USING (file_path, line_number))"""


def rule_sql(rule: Rule) -> str:
    score = " + ".join(f"(CASE WHEN {c.sql()} THEN CAST({weight} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)" for weight, c in rule.signals)
    cwe = quoted(rule.cwe) if rule.cwe_when is None else f"CASE WHEN {rule.cwe_when[0].sql()} THEN {quoted(rule.cwe_when[1])} ELSE {quoted(rule.cwe)} END"
    snippet = strip_sql("line") if rule.sink_text != "match" else "CAST(NULL AS VARCHAR)"
    return f"""WITH RECURSIVE {FILES_SQL}, {rule_ctes(rule)},
scored AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) + {score})) AS confidence_score FROM windows)
SELECT file_path, CAST(line_number AS INTEGER) AS line_number, {quoted(rule.rule_id)} AS rule_id, {quoted(rule.kind)} AS vulnerability_type, {quoted(rule.severity)} AS severity,
  CAST({SEVERITIES[rule.severity]} AS INTEGER) AS severity_value, confidence_score, {cwe} AS cwe_id, {_source(rule)} AS source, {_sink(rule)} AS sink, {snippet} AS code_snippet
FROM scored WHERE confidence_score >= {rule.threshold}"""


def last_user_sql() -> str:
    rule_id, kind, severity, cwe, score = DKR_002
    return f"""WITH {FILES_SQL},
d AS (SELECT file_path, lines, list_max(list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], {quoted(LAST_USER)}))) AS last FROM files WHERE language = 'dockerfile')
SELECT file_path, CAST(coalesce(last, len(lines)) AS INTEGER) AS line_number, {quoted(rule_id)} AS rule_id, {quoted(kind)} AS vulnerability_type, {quoted(severity)} AS severity,
  CAST({SEVERITIES[severity]} AS INTEGER) AS severity_value, CAST({score} AS DOUBLE) AS confidence_score, {quoted(cwe)} AS cwe_id, CAST(NULL AS VARCHAR) AS source,
  CASE WHEN last IS NULL THEN 'No non-root USER configured (defaults to root)' ELSE 'Explicitly switched user context to root' END AS sink, {strip_sql('lines[coalesce(last, len(lines))]')} AS code_snippet
FROM d WHERE last IS NULL OR lower(regexp_extract(lines[last], {quoted(LAST_USER)}, 1)) = 'root'"""
