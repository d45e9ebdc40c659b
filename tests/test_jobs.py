"""Jobs from signed deliveries, and their status, as tables and as streams."""

import hashlib
import hmac
import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_tree import rocks, wait_for  # noqa: F401
from tracewell.streaming.jobs import answers, job_registry, job_updates, queued_jobs
from tracewell.streaming.watch import hmac_sha256

KIND = "delivery_id string, event string, signature string, body string, received_at timestamp"
DAY = datetime(2024, 5, 1)


def signed(body, secret=b"k"):
    return "sha256=" + hmac.new(secret, (body or "").encode(), hashlib.sha256).hexdigest()


def push(**more):
    return json.dumps({"ref": "refs/heads/main", "after": "c0", "commits": [{"added": ["a.py"], "modified": ["b.py", "a.py"]}], "repository": {"full_name": "o/r", "clone_url": "u"}, "pusher": {"name": "p"}} | more)


@pytest.mark.parametrize("secret", [b"", b"k", b"x" * 64, b"y" * 200])
def test_hmac(spark, secret):
    texts = ["", "a", "é" * 70, "z" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hmac_sha256(secret, F.col("t").cast("binary")).alias("h")).collect()
    assert [r.h for r in got] == [hmac.new(secret, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_answers_and_jobs(spark):
    pull = {"pull_request": {"number": 7, "head": {"ref": "f", "sha": "c1"}}, "sender": {"login": "s"}}
    cases = {
        "push": ("push", push(), 202), "bare": ("push", "{}", 200), "fix": ("push", push(ref="refs/heads/fix/1"), 200), "none": ("push", push(commits=[{"added": [], "modified": None}]), 200),
        "open": ("pull_request", json.dumps(pull | {"action": "opened"}), 202), "close": ("pull_request", json.dumps(pull | {"action": "closed"}), 200), "ping": ("ping", "{}", 200),
        "cut": ("push", push()[:30], 400), "list": ("push", "[]", 400), "null": ("push", None, 400), "other": (None, push(), 200),
    }
    rows = [(k, e, signed(b), b, DAY) for k, (e, b, _) in cases.items()] + [("bad", "push", signed(push(), b"no"), push(), DAY), ("nosig", "push", None, push(), DAY)]
    table = spark.createDataFrame(rows, KIND)
    assert {r.delivery_id: r.answer for r in answers(table, b"k").collect()} == {k: a for k, (_, _, a) in cases.items()} | {"bad": 401, "nosig": 401}
    jobs = {r.job_id: r for r in queued_jobs(table.union(table), b"k").collect()}
    assert set(jobs) == {"push", "open"} and queued_jobs(table.union(table), b"k").count() == 2
    p, o = jobs["push"], jobs["open"]
    assert (p.repo_name, p.clone_url, p.branch, p.commit_sha, p.pusher, p.pr_number, p.changed) == ("o/r", "u", "main", "c0", "p", None, ["a.py", "b.py"])
    assert (o.repo_name, o.branch, o.commit_sha, o.pusher, o.pr_number, o.changed) == ("unknown/repo", "f", "c1", "s", 7, [])
    assert queued_jobs(table.limit(0), b"k").count() == 0


def test_repeated_and_late_deliveries_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def deliver(name, *rows):
        body = push()
        (source / f"{name}.json").write_text("\n".join(json.dumps({"delivery_id": i, "event": "push", "signature": signed(body), "body": body, "received_at": (DAY + timedelta(minutes=m)).isoformat()}) for i, m in rows))

    stream = spark.readStream.schema(KIND).json(str(source))
    query = queued_jobs(stream, b"k", "1 hour").writeStream.format("memory").queryName("deliveries_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        deliver("a", ("x", 0), ("x", 1), ("y", 2))
        query.processAllAvailable()
        deliver("b", ("x", 30), ("z", 40))
        query.processAllAvailable()
        deliver("c", ("w", 600))
        query.processAllAvailable()
        deliver("d", ("late", 20), ("v", 610))  # far behind the watermark
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.job_id for r in spark.table("deliveries_seen").collect()) == ["v", "w", "x", "y", "z"]


def history(rng):
    return [(f"j{rng.randrange(6)}", rng.choice(["queued", "running", "done", "failed", "odd", None]), DAY + timedelta(seconds=rng.randrange(50))) for _ in range(120)]


def brute(events):
    out = {}
    for job in {j for j, s, _ in events if s in ("queued", "running", "done", "failed")}:
        at = lambda *names: min([t for j, s, t in events if j == job and s in names], default=None)
        ends = sorted((t, s) for j, s, t in events if j == job and s in ("done", "failed"))
        out[job] = (ends[0][1] if ends else "running" if at("running") else "queued", at("queued"), at("running"), ends[0][0] if ends else None)
    return out


def test_the_registry_depends_on_no_order(spark):
    rng = random.Random(2)
    events = history(rng) + [("only", "odd", DAY), ("waits", "queued", DAY), ("runs", "running", DAY)]
    for _ in range(2):
        rng.shuffle(events)
        got = {r.job_id: tuple(r)[1:] for r in job_registry(spark.createDataFrame(events + events[:30], "job_id string, status string, at timestamp")).collect()}
        assert got == brute(events)
    assert job_registry(spark.createDataFrame([], "job_id string, status string, at timestamp")).count() == 0


def test_a_stream_of_events_ends_as_the_registry(rocks, tmp_path):  # noqa: F811
    spark, source, last = rocks, tmp_path / "in", {}
    source.mkdir()
    events = history(random.Random(3))

    def send(name, rows):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"job_id": j, "status": s, "at": t.isoformat()}) for j, s, t in rows))

    stream = spark.readStream.schema("job_id string, status string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))

    def start():
        keep = lambda df, _: last.update({r.job_id: tuple(r)[1:] for r in df.collect()})
        return job_updates(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    for k in range(3):
        send(k, events[k * 40 : k * 40 + 60])  # some events come twice
        time.sleep(0.05)
    query = start()
    wait_for(query, lambda: last == brute(events[:140]))
    query.stop()
    more = [("j0", "queued", DAY - timedelta(days=1)), ("new", "running", DAY)]
    send("more", more)
    query = start()  # what was settled before the stop is still known
    try:
        wait_for(query, lambda: last == brute(events[:140] + more))
    finally:
        query.stop()
