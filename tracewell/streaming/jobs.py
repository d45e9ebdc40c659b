"""Scan jobs from webhook deliveries, and where each job stands.

Deliveries are checked, parsed and made into jobs by columns alone; repeated deliveries are dropped within a watermark. A job's
status is a fold of its events that doesn't depend on their order or number: the first time of each kind counts, so late and repeated
events change nothing that is settled. The fold is the same over a table and in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.streaming.watch import changed_files, makes_job, scan_jobs, signature_valid

_NAMES = "added array<string>, modified array<string>"
PAYLOAD = (
    f"action string, ref string, after string, commits array<struct<{_NAMES}>>, repository struct<full_name: string, clone_url: string>, pusher struct<name: string>, "
    "sender struct<login: string>, pull_request struct<number: long, head: struct<ref: string, sha: string>>"
)
STATUSES = ("queued", "running", "done", "failed")
REGISTRY = "job_id string, status string, queued_at timestamp, started_at timestamp, completed_at timestamp"


def _read(deliveries: DataFrame, secret: bytes) -> DataFrame:
    """Deliveries with what their bodies say, whether they are signed, and whether the body is a JSON object."""
    push, head = F.col("event") == "push", F.col("payload.pull_request.head")
    return deliveries.withColumn("payload", F.from_json("body", PAYLOAD)).select(
        *deliveries.columns, F.col("event").alias("kind"), F.col("payload.action").alias("action"),
        F.when(push, F.regexp_replace(F.coalesce("payload.ref", F.lit("")), "^refs/heads/", "")).otherwise(head["ref"]).alias("branch"),
        F.when(push, F.col("payload.commits")).alias("commits"), F.coalesce("payload.repository.full_name", F.lit("unknown/repo")).alias("repo_name"),
        F.coalesce("payload.repository.clone_url", F.lit("")).alias("clone_url"), F.when(push, F.col("payload.after")).otherwise(head["sha"]).alias("commit_sha"),
        F.coalesce(F.when(push, F.col("payload.pusher.name")).otherwise(F.col("payload.sender.login")), F.lit("unknown")).alias("pusher"),
        F.col("payload.pull_request.number").alias("pr_number"), signature_valid(secret)(F.col("body"), F.col("signature")).alias("signed"),
        (F.try_parse_json("body").isNotNull() & F.trim("body").startswith("{")).alias("whole"),
    )


def queued_jobs(deliveries: DataFrame, secret: bytes, late: str = "1 hour") -> DataFrame:
    """job_id, repo_name, clone_url, branch, commit_sha, pusher, pr_number, changed, received_at: a job per delivery that asks for one.

    Wrong signatures, bodies that are no JSON and events that change no code make none. A delivery that comes again within ``late`` makes
    one job; its id is the job's. Works on tables and streams.
    """
    jobs = scan_jobs(_read(deliveries, secret).where("signed and whole"))
    key = ["delivery_id"]
    once = jobs.withWatermark("received_at", late).dropDuplicatesWithinWatermark(key) if deliveries.isStreaming else jobs.dropDuplicates(key)
    return once.select(F.col("delivery_id").alias("job_id"), "repo_name", "clone_url", "branch", "commit_sha", "pusher", "pr_number", "changed", "received_at")


def answers(deliveries: DataFrame, secret: bytes) -> DataFrame:
    """delivery_id, answer: 401 for a wrong signature, 400 for a body that is no JSON object, 202 for what makes a job, else 200."""
    answer = F.when(~F.col("signed"), 401).when(~F.coalesce("whole", F.lit(False)), 400).when(makes_job(F.col("changed")), 202).otherwise(200)
    return _read(deliveries, secret).withColumn("changed", changed_files(F.col("commits"))).select("delivery_id", answer.alias("answer"))


def job_registry(events: DataFrame) -> DataFrame:
    """The registry of all jobs from their events (job_id, status, at): status, queued_at, started_at, completed_at.

    The first end of a job counts, done before failed at the same time; a job that has ended doesn't run again, one that has started
    isn't queued. Events of unknown status are passed over; a job without any other is not listed.
    """
    first = lambda *names: F.min(F.when(F.col("status").isin(*names), F.col("at")))
    end = F.min(F.when(F.col("status").isin("done", "failed"), F.struct("at", "status")))
    folded = events.where(F.col("status").isin(*STATUSES)).groupBy("job_id").agg(first("queued").alias("queued_at"), first("running").alias("started_at"), end.alias("end"))
    status = F.coalesce("end.status", F.when(F.col("started_at").isNotNull(), "running"), F.lit("queued"))
    return folded.select("job_id", status.alias("status"), "queued_at", "started_at", F.col("end.at").alias("completed_at"))


class JobState(StatefulProcessor):
    """The times a job was first queued, started and ended, in microseconds, and how it ended; forgotten ``keep_ms`` after its last event."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "queued long, started long, ended long, how string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = tuple(self.times.get()) if self.times.exists() else (None, None, None, None)
        queued, started, ended, how = old
        first = lambda a, b: b if a is None else min(a, b)
        for r in rows:
            if r.status == "queued":
                queued = first(queued, r.at)
            elif r.status == "running":
                started = first(started, r.at)
            elif r.status in ("done", "failed") and (ended is None or (r.at, r.status) < (ended, how)):
                ended, how = r.at, r.status
        new = (queued, started, ended, how)
        if new != old:
            self.times.update(new)
            yield Row(job_id=key[0], status=how or ("running" if started is not None else "queued"), queued_at=queued, started_at=started, completed_at=ended)

    def close(self) -> None:
        pass


def job_updates(events: DataFrame, keep_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """A stream of the registry's rows as they change, from a stream of events; the last row of a job is what ``job_registry`` has."""
    known = events.where(F.col("status").isin(*STATUSES) & F.col("at").isNotNull()).select("job_id", "status", F.unix_micros("at").alias("at"))
    out = known.groupBy("job_id").transformWithState(JobState(keep_ms), "job_id string, status string, queued_at long, started_at long, completed_at long", "Update", "ProcessingTime")
    return out.select("job_id", "status", *[F.timestamp_micros(c).alias(c) for c in ("queued_at", "started_at", "completed_at")])
