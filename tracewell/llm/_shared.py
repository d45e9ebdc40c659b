"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.cut import cut, new_table


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return new_table(spark, name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    What was shuffled for the table is needed no more, so Spark deletes these files when it is written; the setting is put back.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return cut(df, name)
    finally:
        conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str) -> Column:
    """Unsigned crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def unit_hash(*columns: str) -> Column:
    """A fixed pseudo-random number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))

def sized(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``most``; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = most - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == most:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def release() -> None:
    """Give back what earlier tasks of other operators keep in this Python worker: tables of token pieces, and memory that is free.

    Workers serve one stage after the other, and an executor's memory is that of all its workers.
    """
    if (tokens := sys.modules.get("tracewell.llm._tokens")) is not None:
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


#: Rows of an Arrow batch of whole texts, of which some are very long; Spark's own default is ten times that.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python in batches of ``BATCH_ROWS`` rows at most; a smaller setting stays.

    A batch is held by the JVM and by Python at once, for each task of an executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
