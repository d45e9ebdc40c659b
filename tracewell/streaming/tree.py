"""A watched source tree: every poll lists it, state per path tells what was added, modified and deleted, and changed files are scanned.

Listing and reading are done by tasks, a part of the tree each, so the tree has to lie where all executors see it. What a path was
last seen as is kept in the state store and survives a restart with the same checkpoint.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tracewell.functions.text import split_lines
from tracewell.operators.cut import cut
from tracewell.operators.scan import scan
from tracewell.sources.files import EXCLUDED, MOST_BYTES, decoded, language_of

#: Times are microseconds.
SEEN = "file_path string, mtime long, length long"
CHANGE = "file_path string, change string, mtime long, length long"


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class TreeListing(DataSource):
    """Stream format ``source_tree``: the files below ``path``, all of them in every batch; excluded folders are not entered."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SEEN

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TreeReader(self.options["path"], tuple(filter(None, self.options.get("excluded", "").split(","))))


class TreeReader(DataSourceStreamReader):
    def __init__(self, root: str, excluded: tuple[str, ...]):
        self.root, self.excluded = root.removeprefix("file://").rstrip("/"), excluded

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The root's own files, and each folder in it."""
        below = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in self.excluded] if os.path.isdir(self.root) else []
        return [_Part("", False), *(_Part(name, True) for name in sorted(below))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for folder, inner, names in os.walk(os.path.join(self.root, partition.folder)):
            inner[:] = [d for d in inner if d not in self.excluded] if partition.deep else []
            for name in names:
                path = os.path.join(folder, name)
                try:
                    found = os.stat(path)
                except OSError:
                    continue  # gone since it was listed
                yield os.path.relpath(path, self.root), found.st_mtime_ns // 1000, found.st_size


class PathState(StatefulProcessor):
    """What each path was last seen as; a timer that each sighting sets anew tells that it is gone."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "mtime long, length long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = max(rows, key=lambda r: r.mtime)
        old = self.seen.get() if self.seen.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        if old is None or now.mtime > old[0]:
            self.seen.update((now.mtime, now.length))
            yield Row(file_path=key[0], change="added" if old is None else "modified", mtime=now.mtime, length=now.length)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mtime, length = self.seen.get()
        self.seen.clear()
        yield Row(file_path=key[0], change="deleted", mtime=mtime, length=length)

    def close(self) -> None:
        pass


def tree_changes(spark: SparkSession, root: str, patience_ms: int = 5000, excluded: tuple[str, ...] = EXCLUDED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A stream of file_path (relative), change (added, modified, deleted), mtime, length of the supported files below ``root``.

    Modified is later than before. A file counts as deleted when no poll has seen it for ``patience_ms``, which should be above the
    time between two polls. Files over ``most_bytes``, excluded folders and unknown extensions are passed over as a scan does; a file
    that grows over the limit counts as deleted. The session's state store must be RocksDB's.
    """
    spark.dataSource.register(TreeListing)
    listed = spark.readStream.format("source_tree").option("path", root).option("excluded", ",".join(excluded)).load()
    kept = listed.where((F.col("length") <= most_bytes) & language_of(F.col("file_path")).isNotNull())
    return kept.groupBy("file_path").transformWithState(PathState(patience_ms), CHANGE, "Update", "ProcessingTime").withColumn("mtime", F.timestamp_micros("mtime"))


def with_lines(changes: DataFrame, root: str) -> DataFrame:
    """file_path, change, language, lines of the changed files, read and decoded as by a scan; no lines for deleted ones."""
    base = root.removeprefix("file://").rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, change in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = None
                if change != "deleted":
                    try:
                        with open(os.path.join(base, path), "rb") as f:
                            content = f.read()
                    except OSError:
                        continue  # deleted since; its timer will tell
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([change]), pa.array([content], pa.binary())], names=["file_path", "change", "content"])

    read = changes.select("file_path", "change").mapInArrow(run, "file_path string, change string, content binary").withColumn("language", language_of(F.col("file_path")))
    return read.select("file_path", "change", "language", split_lines(decoded(F.col("content"), F.col("language"))).alias("lines"))


def watch_tree(spark: SparkSession, root: str, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, interval: str = "2 seconds", **options) -> DataStreamWriter:
    """Watch ``root``: ``sink(changes, findings, batch number)`` gets what changed since the last poll and the findings of changed
    files. A poll without changes calls nothing; a batch may come again after a failure, under the same number."""

    def scanned(batch: DataFrame, number: int) -> None:
        files = cut(batch, "watched")
        if files.take(1):
            sink(files.select("file_path", "change"), scan(files.where("change <> 'deleted'")), number)

    changed = with_lines(tree_changes(spark, root, **options), root)
    return changed.writeStream.outputMode("update").foreachBatch(scanned).option("checkpointLocation", checkpoint).trigger(processingTime=interval)
