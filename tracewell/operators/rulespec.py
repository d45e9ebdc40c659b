"""Rules as data: where a rule applies, what its sinks look like, and how evidence around a sink adds up.

A condition compiles to a Spark column over a sink's ``line``, its ``w`` (window) and ``sink`` (matched text), and to DuckDB SQL
for the oracle. The column reads ``line_low`` and ``w_low`` too, the same in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.operators.factors import guarded_match


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Match:
    """A pattern is found in ``line``, ``w`` or ``sink``."""

    scope: str
    pattern: str
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern

    def column(self) -> Column:
        text = F.col(self.scope)
        return guarded_match(self.regex, text, F.lower(text) if self.scope == "sink" else F.col(f"{self.scope}_low"))

    def sql(self) -> str:
        return f"regexp_matches({self.scope}, {quoted(self.regex)})"


@dataclass(frozen=True)
class Some:
    """One capture of a pattern at least that, trimmed, is not empty and begins with no quote."""

    pattern: str
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern

    def column(self) -> Column:
        return F.exists(F.regexp_extract_all(F.col("w"), F.lit(self.regex), 1), lambda x: x.rlike(r"""^\s*[^"'\s]""") | x.rlike(r"^\s+$"))

    def sql(self) -> str:
        return f"""len(list_filter(regexp_extract_all(w, {quoted(self.regex)}, 1), lambda x: regexp_matches(x, '^\\s*[^"''\\s]') OR regexp_matches(x, '^\\s+$'))) > 0"""


@dataclass(frozen=True)
class Distinct:
    """At least ``least`` distinct upper-cased matches in the window."""

    pattern: str
    least: int

    def column(self) -> Column:
        found = F.regexp_extract_all(F.col("w"), F.lit(f"(?i){self.pattern}"), 0)
        return F.size(F.array_distinct(F.transform(found, F.upper))) >= self.least

    def sql(self) -> str:
        return f"len(list_distinct(list_transform(regexp_extract_all(w, {quoted('(?i)' + self.pattern)}, 0), lambda x: upper(x)))) >= {self.least}"


@dataclass(frozen=True)
class Guarded:
    """The window checks the very variable that the sink is given."""

    forms: tuple[str, ...]  # with VAR for the variable
    argument: str = r"\(\s*([a-zA-Z_][a-zA-Z0-9_]*)\b"

    def column(self) -> Column:
        rest = F.expr("substring(line, instr(line, sink))")
        var = F.regexp_extract(rest, self.argument, 1)
        parts = [F.concat(*[x for k, p in enumerate(form.split("VAR")) for x in ([var, F.lit(p)] if k else [F.lit(p)])]) for form in self.forms]
        return (var != "") & F.regexp_like("w", F.concat(F.lit("(?i)"), F.concat_ws("|", *parts)))

    def sql(self) -> str:
        var = f"regexp_extract(substring(line, instr(line, sink)), {quoted(self.argument)}, 1)"
        parts = " || '|' || ".join(" || ".join([quoted(p) if not k else f"{var} || {quoted(p)}" for k, p in enumerate(form.split("VAR"))]) for form in self.forms)
        return f"({var} <> '' AND regexp_matches(w, '(?i)' || {parts}))"


@dataclass(frozen=True)
class All:
    parts: tuple

    def column(self) -> Column:
        out = self.parts[0].column()
        for p in self.parts[1:]:
            out = out & p.column()
        return out

    def sql(self) -> str:
        return "(" + " AND ".join(p.sql() for p in self.parts) + ")"


@dataclass(frozen=True)
class AnyOf:
    parts: tuple

    def column(self) -> Column:
        out = self.parts[0].column()
        for p in self.parts[1:]:
            out = out | p.column()
        return out

    def sql(self) -> str:
        return "(" + " OR ".join(p.sql() for p in self.parts) + ")"


@dataclass(frozen=True)
class Not:
    part: object

    def column(self) -> Column:
        return ~self.part.column()

    def sql(self) -> str:
        return f"NOT ({self.part.sql()})"


@dataclass(frozen=True)
class Always:
    def column(self) -> Column:
        return F.lit(True)

    def sql(self) -> str:
        return "TRUE"


@dataclass(frozen=True)
class Rule:
    """One detection rule. ``signals`` are (weight, condition), summed in order as doubles and clamped to [0, 1]."""

    rule_id: str
    languages: tuple[str, ...]
    sink: str
    kind: str  # vulnerability type
    severity: str
    cwe: str
    source: str
    signals: tuple[tuple[float, object], ...] = ()
    ignore_case: bool = True
    before: int = 0
    after: int = 1
    threshold: float = 0.5
    skip_comments: bool = False
    backtrack: str | None = None  # pattern of the variable given to the sink
    cwe_when: tuple[object, str] | None = None  # a condition, and the CWE where it holds
    snippets: tuple[tuple[str, bool], ...] = ()  # patterns (and whether to ignore case) that tell the source
    sink_text: str = "match"  # or ``line``, ``port``, ``acl``, or a text of its own
    source_when: tuple[object, str] | None = None  # a condition, and the source where it holds
    enabled: bool = True
    references: tuple[str, ...] = ()
    also: str | None = None  # second sink pattern, where the first isn't found; case is ignored

    @property
    def regex(self) -> str:
        return f"(?i){self.sink}" if self.ignore_case else self.sink


SEVERITIES = {"INFO": 1, "LOW": 2, "MEDIUM": 3, "HIGH": 4, "CRITICAL": 5}
