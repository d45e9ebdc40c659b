"""Ends lineage in a table of the shared folder, so that a lost executor costs no earlier work."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Where neither is set, a temporary folder is set if all work is done on this machine, as in tests; on a cluster that is an
    error, as executors don't share such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tracewell-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_groups(df: DataFrame, keys: list[str], fold: Callable[[list[dict]], Iterable[dict]], schema: StructType | str) -> DataFrame:
    """``fold(rows)`` of each group of equal keys, for groups that are small and many.

    Rows are dealt out by key and sorted, so a task reads group after group and holds one of them at a time.
    """
    made = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            out += fold(list(group))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, made)


def fold_flagged(df: DataFrame, keys: list[str], flag: str, fold: Callable[[list[dict]], Iterable[dict]], schema: StructType) -> DataFrame:
    """``fold(rows)`` of each group of equal ``keys`` among the rows where ``flag`` holds; the others pass as they are, as Arrow.

    ``df`` lies so that a group is in one partition, group after group, as behind a window over ``keys``.
    """
    arrow, names = to_arrow_schema(schema), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            flagged = batch.column(flag)
            if (plain := batch.filter(pc.invert(flagged))).num_rows:
                yield plain.select(names).cast(arrow)
            out: list[dict] = []
            for key, group in groupby(batch.filter(flagged).to_pylist(), key=lambda r: tuple(r[k] for k in keys)):
                if held and tuple(held[0][k] for k in keys) != key:
                    out += fold(held)
                    held = []
                held += group
            if out:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in out], arrow)
        if held:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in fold(held)], arrow)

    return df.mapInArrow(run, schema)
