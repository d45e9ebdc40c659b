"""Incremental scans with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracewell.functions.text import split_lines
from tracewell.operators.scan import scan
from tracewell.sources.files import EXCLUDED, MOST_BYTES, decoded, in_excluded_folder, language_of, relative_to


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """file_path, change (added, modified, deleted) between two snapshots (file_path, mtime); modified is later than before."""
    old = before.select("file_path", F.col("mtime").alias("old"))
    new = now.select("file_path", F.col("mtime").alias("new"))
    both = new.join(old, "file_path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") > F.col("old"), "modified")
    return both.select("file_path", change.alias("change")).where("change is not null")


def file_stream(spark: SparkSession, root: str, most_files: int = 1000, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """A stream of new files below ``root``: file_path, language, lines; sizes, folders and encodings as ``read_files`` has them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(root)
    files = raw.withColumn("file_path", relative_to(root, F.col("path"))).withColumn("language", language_of(F.col("path")))
    files = files.where((F.col("length") <= MOST_BYTES) & F.col("language").isNotNull() & ~in_excluded_folder(F.col("file_path"), excluded))
    return files.select("file_path", "language", split_lines(decoded(F.col("content"), F.col("language"))).alias("lines"))


def watch(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "2 seconds") -> DataStreamWriter:
    """Scan each micro-batch of ``files`` and hand its findings to ``sink``, which should be idempotent by batch number."""
    return files.writeStream.foreachBatch(lambda batch, number: sink(scan(batch), number)).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def latest_buffers(buffers: DataFrame) -> DataFrame:
    """Of edits (uri, version, text) the last of each document."""
    return buffers.groupBy("uri").agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"))


def finding_trend(findings: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings per window of ``detected_at`` and severity; works on streams, with late rows up to ``late``."""
    return findings.withWatermark("detected_at", late).groupBy(F.window("detected_at", window), "severity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "severity", "n")


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """The HMAC-SHA256 of a binary column as lower-case hex."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda byte: F.lit(bytes(k ^ byte for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signature_valid(secret: bytes) -> Callable[[Column, Column], Column]:
    """A predicate on (body, ``sha256=...`` header): whether the signature is the body's. A null body counts as empty."""
    own = lambda body: F.concat(F.lit("sha256="), hmac_sha256(secret, F.coalesce(body.cast("string"), F.lit("")).cast("binary")))
    return lambda body, header: F.coalesce(own(body) == header, F.lit(False))


def changed_files(commits: Column) -> Column:
    """Files that commits (array of struct<added, modified>) add or modify, each once; none for null."""
    none = F.array().cast("array<string>")
    lists = F.transform(commits, lambda c: F.concat(F.coalesce(c["added"], none), F.coalesce(c["modified"], none)))
    return F.coalesce(F.array_distinct(F.flatten(lists)), none)


def makes_job(changed: Column, fix_prefix: str = "fix/") -> Column:
    """Whether an event (kind, action, branch) with these changed files asks for a scan."""
    push = (F.col("kind") == "push") & (F.size(changed) > 0) & ~F.coalesce(F.col("branch").startswith(fix_prefix), F.lit(False))
    pull = (F.col("kind") == "pull_request") & F.col("action").isin("opened", "synchronize", "reopened")
    return F.coalesce(push, F.lit(False)) | F.coalesce(pull, F.lit(False))


def scan_jobs(events: DataFrame, fix_prefix: str = "fix/") -> DataFrame:
    """Scan jobs from push and pull-request events (kind, action, branch, commits: array of struct<added, modified>).

    Pushes without added or modified files, or of a branch that begins with ``fix_prefix``, and pull-request actions that change no code make no job.
    """
    jobs = events.withColumn("changed", changed_files(F.col("commits")))
    return jobs.where(makes_job(F.col("changed"), fix_prefix))
