"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as fit, then the binary digits of
the rest, longest first. Each piece is a sequence of its own, in the bucket of its length, so no sequence crosses documents,
none is padded, and batches are drawn from buckets of equal length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import bound_batches
from tracewell.llm._tokens import encoder, in_chunks

#: Pieces that one Arrow batch holds.
PIECES = 20_000


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, longest first, that add up to ``n``; none is above ``longest``."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if (n % longest) >> k & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    ``longest`` must be a power of two. A null or empty text gives one piece that holds the end id. Repeated rows and null ids
    are packed like any other row; an empty table gives no rows; extra columns are ignored. ``sequence_id`` is the bucket's
    number (0 for the longest), the task's partition and a running number there, so no shuffle or second pass is needed.
    Special tokens' strings in a text become their single ids, as the library does by default.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    bound_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    sizes = 1 << np.arange(longest.bit_length() - 2, -1, -1)  # of the pieces that are not the longest

    def pieces(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document (by its place in ``tokens``) and length of all pieces in order; as ``piece_lengths`` of each."""
        doc, place = np.nonzero((tokens[:, None] & sizes) > 0)
        whole = np.repeat(np.arange(len(tokens)), tokens // longest)
        owner = np.r_[whole, doc]
        order = np.argsort(owner, kind="stable")
        return owner[order], np.r_[np.full(len(whole), longest), sizes[place]][order]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        part, made = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts):
                coded, ends = coder.encode_flat(texts[a:b], end_id)
                tokens = np.diff(ends)
                owner, length = pieces(tokens)
                at = np.r_[0, np.cumsum(length)]
                bucket = longest.bit_length() - 1 - np.log2(length).astype(np.int64)
                number = np.empty(len(length), np.int64)
                for k in np.unique(bucket):
                    number[bucket == k] = np.arange(made[k], made[k] + (bucket == k).sum())
                made += np.bincount(bucket, minlength=len(made))
                for x in range(0, len(length), PIECES):
                    y = min(x + PIECES, len(length))
                    values = pa.py_buffer(coded[at[x] : at[y]].astype("<u4").tobytes())
                    ids = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(((at[x : y + 1] - at[x]) * 4).astype("<i4").tobytes()), values])
                    some = owner[x:y]
                    columns = (at[:-1] - ends[owner])[x:y], length[x:y], tokens[some], ((bucket << 58) + (part << 34) + number)[x:y], np.zeros(y - x, np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), *map(pa.array, columns), ids], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        pack, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
