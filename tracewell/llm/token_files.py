"""Token-ID files: flat unsigned integers and 64-bit document offsets, one shard per range of document ids.

Documents are range-partitioned and sorted by id, so shard after shard is in ascending order. A task writes its shard as
``shard-N.bin`` (ids, 16 or 32 bits by vocabulary size), ``shard-N.idx`` (n+1 offsets in ids, signed 64-bit) and
``shard-N.doc`` (document ids, signed 64-bit), under a temporary name that is then renamed, so a retried task leaves the same
files. The driver sees one row per shard and turns the counts into bases by prefix sums, kept in ``manifest.json``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tokens import encoder, in_chunks

NULL_ID = np.iinfo(np.int64).min
BATCH_BYTES = 8 << 20
SHARD_BYTES = 256 << 20


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Encode every whole text, append ``end_id``, and write the files to the folder ``out``, which all executors must share.

    A null text is empty and gives the end id alone; a null id is written as the smallest 64-bit integer and comes first.
    Rows with equal ids are all written, side by side, longer texts after shorter ones. An empty table gives no shards.
    Extra columns are ignored. Special tokens' strings in a text become their single ids, as the library does by default. Where
    ``shards`` isn't given, there is one for each ``SHARD_BYTES`` of text, and one per shuffle partition at least. Returns the
    manifest: one entry per shard with its base.
    """
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        kind = np.dtype("<u2" if max(coder.vocab_size, end_id + 1) <= 1 << 16 else "<u4")
        fs, root = pafs.FileSystem.from_uri(out)
        name, mark = f"shard-{TaskContext.get().partitionId():06d}", uuid.uuid4().hex
        fs.create_dir(root, recursive=True)
        lengths, ids, sink = [], [], None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids.append(batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype("<i8"))
            for a, b in in_chunks(texts):
                sink = sink or fs.open_output_stream(f"{root}/{name}.bin.{mark}")
                coded, ends = coder.encode_flat(texts[a:b], end_id)
                lengths.append(np.diff(ends))
                sink.write(coded.astype(kind).tobytes())
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        for ending, data in (("idx", offsets), ("doc", np.concatenate(ids))):
            with fs.open_output_stream(f"{root}/{name}.{ending}.{mark}") as f:
                f.write(data.tobytes())
        for ending in ("bin", "idx", "doc"):
            fs.move(f"{root}/{name}.{ending}.{mark}", f"{root}/{name}.{ending}")
        yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])], "width": pa.array([kind.itemsize], pa.int32())})

    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(shards, F.col("id"))
        .sortWithinPartitions(F.col("id"), F.length("text"), F.col("text"))
        .mapInArrow(write, "shard string, n_docs long, n_tokens long, width int")
        .collect()  # one row per shard
    )
    found = sorted((r.asDict() for r in rows), key=lambda r: r["shard"])
    manifest = [r | {"base": base} for r, base in zip(found, [0, *accumulate(r["n_tokens"] for r in found)], strict=False)]
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: mapped where it is a local or mounted file, read otherwise."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Read the files back: doc_id, start (ids before the document over all shards), n_tokens, ids (little-endian unsigned 32-bit).

    A task reads the shards it is given and passes them on in batches of bounded size. No shards give an empty result.
    """
    fs, root = pafs.FileSystem.from_uri(out)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for r in (r for batch in batches for r in batch.to_pylist()):
            flat = _mapped(fs, f"{root}/{r['shard']}.bin", f"<u{r['width']}")
            offsets, docs = _mapped(fs, f"{root}/{r['shard']}.idx", "<i8"), _mapped(fs, f"{root}/{r['shard']}.doc", "<i8")
            a = 0
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES // 4, "right")) - 1)
                at, part = offsets[a : b + 1], flat[offsets[a] : offsets[b]].astype("<u4")
                ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((at - at[0]) * 4).astype("<i4").tobytes()), pa.py_buffer(part.tobytes())])
                own = np.asarray(docs[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(r["base"] + at[:-1]), pa.array(np.diff(at)), ids], schema=schema)
                a = b

    rows = [(r["shard"], r["base"], r["width"]) for r in manifest]
    shards = spark.createDataFrame(rows, "shard string, base long, width int").repartition(max(1, len(rows)))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
