"""The scan: rules over the lines of files, as one narrow plan.

Lines are exploded once. A line's candidates are the rules of the file's language of whose sink pattern a literal factor stands in
it; only these patterns are tried. Windows are cut out and evidence is summed for hits alone, its patterns behind their factors too.
There is no shuffle.

Columns that several expressions read are computed in a projection, where Spark compiles them, and pass a generator, so that the
optimizer doesn't copy their expressions to where they are used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import context_window, is_comment, strip
from tracewell.operators.catalogue import DKR_002, LAST_USER, OPEN_PORT, PUBLIC_ACL, RULES, USER_INPUT
from tracewell.operators.factors import may_be_empty, may_match
from tracewell.operators.rulespec import SEVERITIES, Rule

#: Words that back-tracking doesn't follow, and how far it looks (fixed values).
NOT_FOLLOWED = ("None", "True", "False", "self", "this", "str", "String", "SELECT", "INSERT", "UPDATE", "DELETE")
REACH = 150
ALL_LANGUAGES = "*"


def _matched(rule: Rule) -> Column:
    """The text that the sink pattern matches on the line; empty where it isn't found."""
    first = F.regexp_extract("line", rule.regex, 0)
    return first if rule.also is None else F.when(first != "", first).otherwise(F.regexp_extract("line", f"(?i){rule.also}", 0))


def _patterns(rule: Rule) -> list[str]:
    return [rule.regex] if rule.also is None else [rule.regex, f"(?i){rule.also}"]


def _near(rule: Rule) -> Column:
    """A factor of a sink pattern stands on the line; true for a rule of which one pattern has none."""
    found = [may_match(p, F.col("line"), F.col("line_low")) for p in _patterns(rule)]
    return F.lit(True) if any(f is None for f in found) else reduce(lambda a, b: a | b, found)


def _candidates(rules: list[Rule]) -> Column:
    """Numbers of the rules that may find a sink on the line, with commas between; array functions would not be compiled."""
    of = lambda language: F.concat_ws(",", *[F.when(_near(r), F.lit(str(k))) for k, r in enumerate(rules) if language in r.languages or ALL_LANGUAGES in r.languages])
    languages = sorted({x for r in rules for x in r.languages} - {ALL_LANGUAGES})
    everywhere = of(ALL_LANGUAGES) if any(ALL_LANGUAGES in r.languages for r in rules) else F.lit("")
    if not languages:
        return everywhere
    out = F.when(F.col("language") == languages[0], of(languages[0]))
    for language in languages[1:]:
        out = out.when(F.col("language") == language, of(language))
    return out.otherwise(everywhere)


def tracked_lines(lines: Column, line_number: Column, variable: Column, before: Column) -> Column:
    """Lines above the window that define the sink's variable, or what its definitions use, in file order.

    A fold over the lines above the sink, nearest first: where a followed variable is assigned, the names on the right are
    followed too. Of several followed variables assigned on one line the one followed first counts.
    """
    top = F.greatest(F.lit(1), line_number - REACH)
    above = F.when(line_number > 1, F.sequence(line_number - 1, top, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    assigned = lambda line, var: F.regexp_like(line, F.concat(F.lit(r"\b"), var, F.lit(r"\s*\+?=")))

    def step(acc: Column, at: Column) -> Column:
        line = F.element_at(lines, at)
        hits = F.filter(acc["names"], lambda v: assigned(line, v))
        var = F.get(hits, F.lit(0))
        right = F.call_function("regexp_extract", line, F.concat(F.lit(r"\b"), var, F.lit(r"\s*(\+?=)\s*(.*)")), F.lit(2))
        words = F.filter(F.regexp_extract_all(right, F.lit(r"\b([a-zA-Z_]\w*)\b"), 1), lambda w: ~w.isin(*NOT_FOLLOWED))
        skipped = strip(line).rlike(r"^(#|//|\*)") | (strip(line) == "")
        out = F.struct(
            F.array_union(acc["names"], words).alias("names"),
            F.when(at < line_number - before, F.concat(F.array(line), acc["found"])).otherwise(acc["found"]).alias("found"),
        )
        return F.when(skipped | (F.size(hits) == 0), acc).otherwise(out)

    start = F.struct(F.array(variable).alias("names"), F.array().cast("array<string>").alias("found"))
    return F.when(variable == "", F.array().cast("array<string>")).otherwise(F.aggregate(above, start, step, lambda acc: acc["found"]))


def _window(rules: list[Rule]) -> Column:
    """The site's window by its own bounds, below the tracked lines where the rule follows variables."""
    w = context_window(F.col("lines"), F.col("line_number"), F.col("before"), F.col("after"))
    following = [r for r in rules if r.backtrack is not None]
    if not following:
        return w
    variable = F.lit("")
    for r in following:
        variable = F.when(F.col("rule") == rules.index(r), F.regexp_extract("line", r.backtrack, 1)).otherwise(variable)
    return F.array_join(F.concat(tracked_lines(F.col("lines"), F.col("line_number"), variable, F.col("before")), F.array(w)), "\n")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, in a projection, and pass a generator as the fields of its only element."""
    made = df.select("*", F.struct(*[v.alias(k) for k, v in columns.items()]).alias("__once"))
    return made.select(*df.columns, F.inline(F.array("__once")))


def evidence(rule: Rule) -> Column:
    """The weights of the signals that hold, added in the rule's order as doubles, clamped to [0, 1]."""
    total = reduce(lambda a, b: a + b, [F.when(c.column(), F.lit(float(weight))).otherwise(F.lit(0.0)) for weight, c in rule.signals], F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def snippets(rule: Rule) -> Column:
    """What is built into the sink's text: captures of the rule's patterns, pattern after pattern."""
    parts = []
    for pattern, ignore_case in rule.snippets:
        text = F.lit(f"(?i){pattern}" if ignore_case else pattern)
        groups = re.compile(pattern).groups
        found = F.regexp_extract_all("w", text, min(groups, 1))
        if groups == 2:
            found = F.zip_with(found, F.regexp_extract_all("w", text, 2), lambda a, b: F.when(a != "", a).otherwise(b))
        elif groups == 1:
            found = F.filter(F.transform(found, strip), lambda x: ~x.rlike("^[\"']"))
        parts.append(found)
    return F.concat(*parts)


def _source(rule: Rule) -> Column:
    if rule.source_when is not None:
        return F.when(rule.source_when[0].column(), rule.source_when[1]).otherwise(rule.source)
    if not rule.snippets:
        return F.lit(rule.source or None).cast("string")
    found = snippets(rule)
    named = F.get(F.filter(F.transform(found, strip), lambda x: (x != "") & x.rlike(f"(?i){USER_INPUT}")), F.lit(0))
    return F.coalesce(named, strip(F.get(found, F.lit(0))))


def _sink(rule: Rule) -> Column:
    if rule.sink_text == "match":
        return F.left(strip(F.col("sink")), F.lit(80))
    if rule.sink_text == "line":
        return strip(F.col("line"))
    if rule.sink_text == "port":
        first = F.regexp_extract("w", f"(?m)^.*{OPEN_PORT}.*$", 0)
        port = F.when(first.contains("22"), "SSH (22)").when(first.contains("3389"), "RDP (3389)").otherwise("All Ports (0)")
        return F.concat(F.lit("Wide-open access to "), port, F.lit(" configured in ingress rules"))
    if rule.sink_text == "acl":
        return F.concat(F.lit("Bucket access ACL set to public: '"), F.regexp_extract("line", f"(?i){PUBLIC_ACL}", 1), F.lit("'"))
    return F.lit(rule.sink_text)


def _choose(rules: list[Rule], of) -> Column:
    """``of(rule)`` of the row's rule."""
    if len(rules) == 1:
        return of(rules[0])
    out = F.when(F.col("rule") == 0, of(rules[0]))
    for k, r in enumerate(rules[1:], 1):
        out = out.when(F.col("rule") == k, of(r))
    return out


def _fixed(rules: list[Rule], of) -> Column:
    """``of(rule)``, a plain value, of the row's rule."""
    return F.get(F.array(*[F.lit(of(r)) for r in rules]), F.col("rule"))


def sink_sites(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row per line and rule whose sink pattern it matches: file_path, language, lines, line_number, line, line_low, rule (its
    number), rule_id, sink, before, after."""
    rules = list(rules)
    both = F.transform("lines", lambda x: F.struct(x.alias("line"), F.lower(x).alias("line_low")))
    lines = files.select("file_path", "language", "lines", F.posexplode(both).alias("pos", "both")).select("file_path", "language", "lines", "pos", "both.line", "both.line_low")
    near = _once(lines, near=_candidates(rules)).where("near <> ''")
    tried = near.withColumn("rule", F.explode(F.split("near", ","))).drop("near").withColumn("rule", F.col("rule").cast("int"))
    sink = _choose(rules, _matched)
    sites = _once(tried, sink=sink)
    loose = [k for k, r in enumerate(rules) if any(may_be_empty(p) for p in _patterns(r))]
    found = F.col("sink") != ""
    for k in loose:
        found = found | (F.col("rule") == k) & reduce(lambda a, b: a | b, [F.col("line").rlike(p) for p in _patterns(rules[k])])
    skipping = [k for k, r in enumerate(rules) if r.skip_comments]
    if skipping:
        found = found & ~(F.col("rule").isin(skipping) & is_comment(F.col("line"), F.col("language")))
    return sites.where(found).select(
        "file_path", "language", "lines", (F.col("pos") + 1).alias("line_number"), "line", "line_low", "rule", _fixed(rules, lambda r: r.rule_id).alias("rule_id"), "sink",
        _fixed(rules, lambda r: r.before).alias("before"), _fixed(rules, lambda r: r.after).alias("after"),
    )


FINDING = ["file_path", "line_number", "rule_id", "vulnerability_type", "severity", "severity_value", "confidence_score", "cwe_id", "source", "sink", "code_snippet"]


def last_user_findings(files: DataFrame) -> DataFrame:
    """Dockerfiles whose last USER is root, or that name none."""
    rule_id, kind, severity, cwe, score = DKR_002
    lines = F.col("lines")
    at = F.array_max(F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(LAST_USER)))
    docker = files.where((F.col("language") == "dockerfile") & F.exists("lines", lambda x: strip(x) != "")).withColumn("at", at)
    docker = docker.where(F.col("at").isNull() | (F.lower(F.regexp_extract(F.element_at(lines, F.col("at")), LAST_USER, 1)) == "root"))
    number = F.coalesce("at", F.size("lines"))
    sink = F.when(F.col("at").isNull(), "No non-root USER configured (defaults to root)").otherwise("Explicitly switched user context to root")
    return docker.select(
        "file_path", number.alias("line_number"), F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("vulnerability_type"), F.lit(severity).alias("severity"),
        F.lit(SEVERITIES[severity]).alias("severity_value"), F.lit(score).alias("confidence_score"), F.lit(cwe).alias("cwe_id"), F.lit(None).cast("string").alias("source"),
        sink.alias("sink"), strip(F.element_at(lines, number)).alias("code_snippet"),
    )


def scan(files: DataFrame, rule_ids: Iterable[str] | None = None, first_hit: bool = False, catalogue: Iterable[Rule] = RULES) -> DataFrame:
    """Findings of the chosen rules (all by default) over ``files`` (file_path, language, lines).

    ``catalogue`` holds the rules to choose from; those that aren't enabled are passed over. ``first_hit`` keeps the first finding
    of each rule in a file.
    """
    catalogue = list(catalogue)
    wanted = set(rule_ids) if rule_ids is not None else {DKR_002[0], *(r.rule_id for r in catalogue)}
    rules = [r for r in catalogue if r.rule_id in wanted and r.enabled]
    out = None
    if rules:
        windows = _once(sink_sites(files, rules), w=_window(rules))
        sites = _once(windows, w_low=F.lower("w"))
        scored = _once(sites, confidence_score=_choose(rules, evidence)).where(F.col("confidence_score") >= _fixed(rules, lambda r: r.threshold))
        cwe = lambda r: F.lit(r.cwe) if r.cwe_when is None else F.when(r.cwe_when[0].column(), r.cwe_when[1]).otherwise(r.cwe)
        listed = [r.sink_text != "match" for r in rules]
        out = scored.select(
            "file_path", "line_number", "rule_id", _fixed(rules, lambda r: r.kind).alias("vulnerability_type"), _fixed(rules, lambda r: r.severity).alias("severity"),
            _fixed(rules, lambda r: SEVERITIES[r.severity]).alias("severity_value"), "confidence_score", _choose(rules, cwe).alias("cwe_id"),
            _choose(rules, _source).alias("source"), _choose(rules, _sink).alias("sink"),
            F.when(F.get(F.array(*map(F.lit, listed)), F.col("rule")), strip(F.col("line"))).alias("code_snippet"),
        )
    if DKR_002[0] in wanted:
        own = last_user_findings(files)
        out = own if out is None else out.unionByName(own)
    if first_hit:
        order = Window.partitionBy("file_path", "rule_id").orderBy("line_number")
        out = out.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return out
