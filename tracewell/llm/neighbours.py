"""Approximate nearest neighbours by collision counting.

An index has ``projections`` arrays, each holding all vectors sorted by one random projection. A query opens a window around
its own projection in every array; a vector collides with it wherever it falls inside. Virtual rehashing widens the windows
step by step, without another index; a vector that has collided often enough is verified with its exact cosine. A query ends
when its k-th best verified vector is nearer than what windows of this width would still miss, or when all have been verified.

Vectors are normalised, so that nearness by distance is nearness by cosine. Rows are dealt out over tasks, each of which
indexes its share and answers every query on it; queries reach the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one broadcast holds.
BLOCK = 4096
#: Rows that one index holds; a task with more builds several.
SHARD = 16_384
#: Width of the last window, in units of how far the k-th best so far strays on a line. 1.0 found 99 in 100 of the true five
#: nearest in 64 dimensions without clusters.
REACH = 1.0


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows are finite and not zero."""
    big = np.abs(vectors).max(1, initial=0)
    ok = np.isfinite(big) & (big > 0)
    v = vectors[ok] / big[ok, None]
    return v / np.linalg.norm(v, axis=1, keepdims=True), ok


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row of ``v``, in double precision, from the original components.

    Both are scaled by powers of two first, which changes no digit but keeps squares of tiny and huge components in range.
    """
    q = np.ldexp(q, -np.frexp(np.abs(q).max(initial=0))[1])
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))


class CollisionIndex:
    """Sorted projections of the unit vectors; ``search`` gives the verified nearest of one query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = 48, threshold: float = 0.6, width: float = 0.1, seed: int = 5, reach: float = REACH):
        self.ids, self.original = ids, vectors
        self.vectors, ok = unit(vectors)
        self.ids, self.original = ids[ok], vectors[ok]
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1], projections))
        self.lines /= np.linalg.norm(self.lines, axis=0)
        placed = self.vectors @ self.lines
        self.order = np.argsort(placed, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(placed, self.order.T, axis=0).T.copy()
        self.needed, self.width, self.reach = max(1, int(threshold * projections)), width, reach

    def search(self, own: int | None, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(id, cosine) of the ``k`` nearest verified ids but ``own``, each by its best row; ties to the smaller id."""
        n = len(self.ids)
        unit_q, ok = unit(query[None, :])
        if not n or not ok[0]:
            return []
        at, scale = unit_q[0] @ self.lines, 1 / np.sqrt(len(query))
        count, verified = np.zeros(n, np.int16), np.zeros(n, bool)
        lo = hi = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at, strict=True)])
        best_rows, best = np.empty(0, np.int64), np.empty(0)
        half = self.width
        while True:
            left = np.array([np.searchsorted(s, x - half, "left") for s, x in zip(self.sorted, at, strict=True)])
            right = np.array([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, at, strict=True)])
            met = [o[a:b] for o, a0, b0, a1, b1 in zip(self.order, left, right, lo, hi, strict=True) for a, b in ((a0, a1), (b1, b0)) if b > a]
            if met:
                count += np.bincount(np.concatenate(met), minlength=n).astype(np.int16)
            lo, hi = left, right
            new = np.flatnonzero((count >= self.needed) & ~verified)
            if len(new):
                verified[new] = True
                rows = new[self.ids[new] != own] if own is not None else new
                found = cosines(query, self.original[rows])
                best_rows, best = np.concatenate([best_rows, rows]), np.concatenate([best, found])
                keep = np.lexsort((self.ids[best_rows], -best))
                keep = keep[np.sort(np.unique(self.ids[best_rows[keep]], return_index=True)[1])[:k]]  # the best row of each id
                best_rows, best = best_rows[keep], best[keep]
            # A vector at distance d strays by d * scale on a line, on average.
            reach = np.sqrt(max(0.0, 2 - 2 * best[-1])) if len(best) >= k else np.inf
            if half >= self.reach * reach * scale or (right - left == n).all():
                return [(int(self.ids[r]), float(c)) for r, c in zip(best_rows, best, strict=True)]
            half *= 1.5


def query_blocks(queries: DataFrame, block: int) -> Iterator[list]:
    n = -(-queries.count() // block)
    for k in range(n):
        yield queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == k).collect()


def nearest_neighbours(embeddings: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, shard: int = SHARD, projections: int = 48) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` (vec_id, embedding) its ``k`` nearest rows of ``embeddings`` found.

    The score is the cosine in double precision; ties go to the smaller id; a query's own id is no candidate; all candidates
    are returned if there are fewer than ``k``. Vectors that are null, empty, zero, of another length than the query, or hold
    a null or non-finite component take no part, nor do rows without id. Of rows with equal ids the best is returned once; of
    queries with equal ids the one of the least components is asked. An empty table on either side gives no rows; extra columns are ignored.
    """
    spark = embeddings.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
    rows, asked = clean(embeddings), clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = max(1, -(-rows.count() // shard))
    shards = rows.repartition(n, "vec_id")
    schema, out = "query_id long, vec_id long, score double", None
    for block_rows in query_blocks(asked, block):
        shared = spark.sparkContext.broadcast([(r.vec_id, np.array(r.embedding)) for r in block_rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, list]] = []

            def answer() -> Iterator[pa.RecordBatch]:
                ids = np.concatenate([a for a, _ in held])
                lists = [x for _, b in held for x in b]
                size = np.array([len(x) for x in lists])
                for d in np.unique(size):
                    own = np.flatnonzero(size == d)
                    index = CollisionIndex(ids[own], np.array([lists[j] for j in own]), projections)
                    found = [(q, i, c) for q, v in shared.value if len(v) == d for i, c in index.search(q, v, k)]
                    columns = list(zip(*found, strict=True)) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

            total = 0
            for batch in batches:
                if batch.num_rows:
                    held.append((batch.column(0).to_numpy(), batch.column(1).to_pylist()))
                    total += batch.num_rows
                if total >= shard:
                    yield from answer()
                    held, total = [], 0
            if held:
                yield from answer()

        found = shards.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
