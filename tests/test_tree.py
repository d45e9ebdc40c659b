"""A watched tree: added, modified, deleted and excluded files, and a restart."""

import os
import time

import pytest

from tracewell.streaming.tree import watch_tree

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def wait_for(query, holds, seconds=60):
    end = time.time() + seconds
    while not holds():
        assert query.isActive, query.exception()
        assert time.time() < end
        time.sleep(0.2)


def test_a_watched_tree(rocks, tmp_path):
    root, batches = tmp_path / "tree", {}

    def sink(changed, findings, number):  # a batch that was cut off comes again under its number
        batches[number] = [[(r.file_path, r.change) for r in changed.collect()], [(r.file_path, r.rule_id) for r in findings.collect()]]

    def changes(first=0):
        return [c for n, (own, _) in sorted(batches.items()) if n >= first for c in own]

    def hits():
        return [h for _, (_, own) in sorted(batches.items()) for h in own]

    def write(name, data, later=0):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        if later:
            os.utime(path, (time.time() + later,) * 2)

    def start():
        return watch_tree(rocks, str(root), sink, str(tmp_path / "checkpoint"), "500 milliseconds", patience_ms=4000, most_bytes=1000).start()

    write("a.py", b"os.system('x' + y)\n")
    write("sub/deep/b.py", b"x = 1\n")
    write("node_modules/c.py", b"DEBUG = True\n")
    write("sub/big.py", b"DEBUG = True\n" + b"#" * 2000)
    write("note.txt", b"DEBUG = True\n")
    write("sub/d.php", b"\xe9\n")
    query = start()
    try:
        wait_for(query, lambda: len(changes()) >= 3)
        assert sorted(changes()) == [("a.py", "added"), ("sub/d.php", "added"), ("sub/deep/b.py", "added")] and hits() == [("a.py", "PY-CMD-001")]
        write("sub/deep/b.py", b"DEBUG = True\n", later=5)
        os.utime(root / "a.py", (1, 1))  # earlier than before: no change
        wait_for(query, lambda: ("sub/deep/b.py", "modified") in changes())
        assert hits()[1:] == [("sub/deep/b.py", "PSEC-CONFIG-PY-001")]
        (root / "sub/d.php").unlink()
        wait_for(query, lambda: ("sub/d.php", "deleted") in changes())
    finally:
        query.stop()
    seen = max(n for n, (own, _) in batches.items() if own)  # the last batch may have been cut off by the stop
    write("e.py", b"x = 1\n")
    query = start()  # what was seen before isn't added again
    try:
        wait_for(query, lambda: ("e.py", "added") in changes())
        (root / "a.py").unlink()
        wait_for(query, lambda: ("a.py", "deleted") in changes())
    finally:
        query.stop()
    assert sorted(set(changes(seen)) - {("sub/d.php", "deleted")}) == [("a.py", "deleted"), ("e.py", "added")] and len(hits()) == 2
