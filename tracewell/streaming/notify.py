"""Messages about a scan as JSON payloads for a chat, a tracker and mail. Nothing is sent; a ``foreachBatch`` or a job posts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.findings import at_least, rank_order, ranked, summary, with_derived
from tracewell.operators.registry import recommendation

#: Findings that a chat message lists.
LISTED = 5


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _shown(name: str, otherwise: str = "N/A") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(otherwise))


def chat_message(findings: DataFrame, target: str, scanner: str = "rules") -> DataFrame:
    """One row ``payload``: header, target and risk, counts, and the first findings by rank with how many more there are."""
    first = with_derived(findings.orderBy(*rank_order(), *[F.asc(c) for c in ("cwe_id", "source", "sink")]).limit(LISTED))
    line = F.struct(*[c.alias(f"o{k}") for k, c in enumerate((-F.col("severity_value"), -F.col("confidence_score")))], "file_path", F.coalesce("line_number", F.lit(0)).alias("at"), "rule_id",
                    _text("*[", F.col("severity"), "]* ", F.col("vulnerability_type"), " at `", F.col("location"), "`").alias("text"))
    top = first.agg(F.transform(F.sort_array(F.collect_list(line)), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["text"])).alias("top"))
    one = summary(findings).crossJoin(top)  # one row each
    mark = lambda text: F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))
    more = F.when(F.col("total") > LISTED, F.concat(F.lit("\n...and "), (F.col("total") - LISTED).cast("string"), F.lit(" more."))).otherwise("")
    block = lambda kind, text=None, fields=None: F.struct(
        F.lit(kind).alias("type"), (F.lit(None).cast("struct<type:string,text:string>") if text is None else text).alias("text"),
        (F.lit(None).cast("array<struct<type:string,text:string>>") if fields is None else fields).alias("fields"),
    )
    head = [
        block("header", F.struct(F.lit("plain_text").alias("type"), F.lit("Security Scan Report").alias("text"))),
        block("section", mark(_text(f"*Target:* `{target}`\n*Scanner:* `{scanner}`\n*Risk Level:* *", F.col("risk_level"), "* (Score: ", F.col("risk_score").cast("string"), ")"))),
        block("section", fields=F.array(*[mark(_text(f"*{s.title()}:* ", F.col(s).cast("string"))) for s in ("critical", "high", "medium", "low")])),
    ]
    tail = [block("divider"), block("section", mark(_text("*Top Findings:*\n", F.array_join("top", "\n"), more)))]
    blocks = F.when(F.col("total") > 0, F.array(*head, *tail)).otherwise(F.array(*head))
    return one.select(F.to_json(F.struct(blocks.alias("blocks"))).alias("payload"))


def tickets(findings: DataFrame, project: str) -> DataFrame:
    """``payload`` of a ticket for each finding of HIGH or above, made where the finding lies."""
    text = _text(
        "A ", F.col("severity"), " vulnerability was found.\n\n*Type:* ", F.col("vulnerability_type"), "\n*Rule ID:* ", _shown("rule_id"), "\n*CWE:* ", _shown("cwe_id"), "\n*File:* ", F.col("file_path"),
        "\n*Line:* ", _shown("line_number"), "\n\n*Recommendation:*\n", recommendation(F.col("vulnerability_type"), F.col("cwe_id")),
    )
    fields = F.struct(
        F.struct(F.lit(project).alias("key")).alias("project"), _text("[", F.col("severity"), "] Security Finding: ", F.col("vulnerability_type"), " in ", F.col("file_path")).alias("summary"),
        text.alias("description"), F.struct(F.lit("Bug").alias("name")).alias("issuetype"),
    )
    return at_least(findings, "HIGH").select("file_path", "line_number", "rule_id", F.to_json(F.struct(fields.alias("fields"))).alias("payload"))


def mail_lines(findings: DataFrame) -> DataFrame:
    """(rank, text) of a mail's body below its counts: all findings by rank, as lines that a job writes side by side."""
    shown = with_derived(ranked(findings))
    return shown.select("rank", _text(F.col("rank").cast("string"), ". [", F.col("severity"), "] ", F.col("vulnerability_type"), " at ", F.col("location"), "\n   Remediation: ", recommendation(F.col("vulnerability_type"), F.col("cwe_id"))).alias("text"))
