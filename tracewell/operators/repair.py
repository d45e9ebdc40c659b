"""Patch and scan again, round by round, as long as findings become fewer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import split_lines
from tracewell.operators.cut import cut
from tracewell.operators.patch import patched
from tracewell.operators.scan import scan

NOT_FEWER, NO_FORM = "The patch leaves as many findings.", "No rewriter knows the form."


def patched_to_rest(files: DataFrame, rule_ids: Iterable[str] | None = None) -> DataFrame:
    """file_path, language, lines, rounds, findings, reason of each of ``files`` (file_path, language, lines), patched as far as it helps.

    A round patches the files that the round before made better, and scans them again; a patch is kept if the file has fewer findings
    then, so the rounds end. ``rounds`` counts the patches kept, ``findings`` what is left, and ``reason`` says why the last patch was
    not kept or made; null for a file without findings. Files are told apart by path; of files of one path each is patched.
    """
    rule_ids = None if rule_ids is None else list(rule_ids)
    count = lambda found, name: found.groupBy("file_path").agg(F.count("*").alias(name))
    todo = cut(files.select("file_path", "language", "lines", F.lit(0).alias("rounds")), "repair")
    found = cut(scan(todo, rule_ids), "repair-findings")
    out = None
    while True:
        state = todo.join(count(found, "findings"), "file_path", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
        made = patched(todo.select("file_path", F.array_join("lines", "\n").alias("code")).distinct(), found)
        made = cut(made.select("file_path", "code", F.col("patched").alias("text"), F.col("reason").alias("given_up"), (F.size("changed_lines") > 0).alias("changed")), "repair-patches")
        tried = state.withColumn("code", F.array_join("lines", "\n")).join(made, ["file_path", "code"], "left").drop("code")
        tried = cut(tried, "repair-tried")
        new = tried.where("changed").select("file_path", "language", split_lines(F.col("text")).alias("lines"), (F.col("rounds") + 1).alias("rounds"))
        again = cut(scan(new, rule_ids), "repair-findings")
        judged = tried.join(count(again, "after"), "file_path", "left")
        better = F.coalesce("changed", F.lit(False)) & (F.coalesce("after", F.lit(0)) < F.col("findings"))
        judged = cut(judged.withColumn("better", better), "repair-judged")
        reason = F.when(F.col("findings") > 0, F.when(F.col("changed"), NOT_FEWER).otherwise(F.coalesce("given_up", F.lit(NO_FORM))))
        settled = judged.where("not better").select("file_path", "language", "lines", "rounds", "findings", reason.alias("reason"))
        out = settled if out is None else out.unionByName(settled)
        kept = judged.where("better")
        if not kept.take(1):
            return out
        todo = cut(kept.select("file_path", "language", split_lines(F.col("text")).alias("lines"), (F.col("rounds") + 1).alias("rounds")), "repair")
        found = again.join(todo.select("file_path").distinct(), "file_path", "left_semi")
