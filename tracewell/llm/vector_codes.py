"""Vector code compression: product codebooks by Lloyd's rounds over cover trees.

Vectors become integers and are cut into parts; each part position has a codebook of its own. Rows are taken in chunks where they
lie; every chunk gets a cover tree per part position, built once and written to a table. A node of a tree covers all points of its
subtree within its radius, which halves from level to level, and holds their number and sum. A round walks the trees: where the
triangle inequality leaves one entry for all points of a node, the node's sum goes to that entry at once; where several stay,
its children are looked at, and the points of an ambiguous leaf are compared exactly, in integers. Only the entries' sums leave a
task, so a round shuffles a few thousand numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import materialise, sized

#: Integer steps of 1.0, parts of a vector, entries of a codebook, rounds.
STEPS, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a chunk, distinct points of a leaf.
CHUNK, LEAF = 4096, 8
#: Sums of squares below it are exact in doubles; beyond it integers are used.
_EXACT = 1 << 52


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and entries."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * points.shape[1] < _EXACT:
        p, b = points.astype(np.float64), book.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (b * b).sum(1) - 2 * (p @ b.T)).astype(np.int64)
    return np.stack([((points - b) ** 2).sum(1) for b in book], 1) if len(book) else np.zeros((len(points), 0), np.int64)


class CoverTree:
    """A cover tree over integer points; equal points are one point that counts as many times.

    ``points`` are in the order of the leaves, so a node's are ``lo[k]:hi[k]``; ``times`` says how often each stands in the chunk and
    ``place`` which of them a row is. A node's children are ``child[k]:child[k + 1]`` (none for a leaf), its centre is the point
    ``centre[k]``, and ``total`` and ``count`` are the sum and number of its rows' points.
    """

    def __init__(self, rows: np.ndarray):
        own, back, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        order: list[np.ndarray] = []
        lo, hi, child, centre, radius = [], [], [], [], []
        level, placed = [(np.arange(len(own)), 0)] if len(own) else [], 0
        self.depth = 0
        # Level by level; points of a level stand in the order of their nodes, so that subtrees are contiguous in the end.
        ranks = np.zeros(len(own), np.int64)
        nodes: list[tuple[np.ndarray, int, list[int]]] = []
        while level:
            self.depth += 1
            following = []
            for members, at in level:
                away = squared(own[members], own[members[at] : members[at] + 1])[:, 0]
                far = int(away.max())
                nodes.append((members, members[at], []))
                radius.append(np.sqrt(float(far)) * (1 + 2.0**-40))
                if len(members) > LEAF:
                    scale = 2.0 ** np.floor(np.log2(np.sqrt(float(far))) - 1e-9) if far > 1 else 0.5
                    for part, k in self._cover(own, members, at, away, scale):
                        nodes[-1][2].append(len(following) + placed + len(level))
                        following.append((part, k))
            placed += len(level)
            level = following
        # Leaves in depth-first order give each node a contiguous range.
        start = np.zeros(len(nodes), np.int64)
        stack, at = [0] if nodes else [], 0
        while stack:
            k = stack.pop()
            start[k] = at
            members, _, below = nodes[k]
            if below:
                stack.extend(reversed(below))
            else:
                order.append(members)
                ranks[members] = at + np.arange(len(members))
                at += len(members)
        for k, (members, mid, below) in enumerate(nodes):
            lo.append(start[k]), hi.append(start[k] + len(members)), centre.append(ranks[mid])
            child.append((below[0], below[-1] + 1) if below else (0, 0))
        moved = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.points, self.times = own[moved], times[moved]
        self.lo, self.hi, self.centre = (np.array(x, np.int64) for x in (lo, hi, centre))
        self.child, self.radius = np.array(child, np.int64).reshape(-1, 2), np.array(radius)
        self.place = ranks[back.reshape(-1)]
        run = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(self.points * self.times[:, None], 0)])
        every = np.concatenate([[0], np.cumsum(self.times)])
        self.total, self.count = run[self.hi] - run[self.lo], every[self.hi] - every[self.lo]
        self.compared = 0

    @staticmethod
    def _cover(own: np.ndarray, members: np.ndarray, at: int, away: np.ndarray, scale: float) -> Iterator[tuple[np.ndarray, int]]:
        """(points, which of them is the centre) of children within ``scale`` of their centres, which lie further apart than that.

        The first has the node's own centre."""
        most = int(scale * scale)
        near = away <= most
        yield (part := members[near]), int(np.flatnonzero(part == members[at])[0])
        left = members[~near]
        while len(left):
            near = squared(own[left], own[left[:1]])[:, 0] <= most
            yield left[near], 0
            left = left[~near]

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(sums, counts) of the points nearest to each entry, and (places of points, entries); ties go to the lower entry."""
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        usable = np.array([not any((book[j] == book[k]).all() for j in range(k)) for k in range(len(book))])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = np.zeros(min(1, len(self.lo)), np.int64)
        open_entries = usable[None, :].repeat(len(nodes), 0)
        while len(nodes):
            away = np.sqrt(squared(self.points[self.centre[nodes]], book).astype(np.float64))
            away[~open_entries] = np.inf
            reach = self.radius[nodes][:, None]
            # Roots and radii are off by one in 2 ** 40 at most; what is further by less stays open.
            slack = 2.0**-38 * (away.min(1)[:, None] + reach + 1)
            open_entries = away - reach <= away.min(1)[:, None] + reach + slack
            sure = open_entries.sum(1) == 1
            own, entry = nodes[sure], open_entries[sure].argmax(1)
            np.add.at(sums, entry, self.total[own])
            np.add.at(counts, entry, self.count[own])
            if len(own):
                found.append(_ranges(self.lo[own], self.hi[own], entry))
            leaf = ~sure & (self.child[nodes, 1] == 0)
            if leaf.any():
                places, which = _ranges(self.lo[nodes[leaf]], self.hi[nodes[leaf]], np.arange(leaf.sum()))
                exact = squared(self.points[places], book)
                exact[~open_entries[leaf][which]] = np.iinfo(np.int64).max
                entry = exact.argmin(1)
                np.add.at(sums, entry, self.points[places] * self.times[places][:, None])
                np.add.at(counts, entry, self.times[places])
                found.append((places, entry))
                self.compared += len(places)
            inner = ~sure & ~leaf
            nodes, of = _ranges(self.child[nodes[inner], 0], self.child[nodes[inner], 1], np.arange(inner.sum()))
            open_entries = open_entries[inner][of]
        return sums, counts, found

    #: What is kept of a tree; integer points fit 32 bits, as do numbers of points and nodes of a chunk.
    FIELDS = {"points": "i4", "times": "i4", "lo": "i4", "hi": "i4", "child": "i4", "centre": "i4", "radius": "f8", "place": "i4", "total": "i8", "count": "i8"}

    def to_bytes(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k), kind).tobytes() for k, kind in self.FIELDS.items()}

    @classmethod
    def from_bytes(cls, held: dict[str, bytes], width: int) -> CoverTree:
        tree = cls.__new__(cls)
        for k, kind in cls.FIELDS.items():
            setattr(tree, k, np.frombuffer(held[k], kind).astype("f8" if kind == "f8" else "i8"))
        tree.points, tree.total, tree.child = tree.points.reshape(-1, width), tree.total.reshape(-1, width), tree.child.reshape(-1, 2)
        tree.compared = 0
        return tree


def _ranges(lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the value of each one's range."""
    size = hi - lo
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + size, size), np.repeat(value, size)


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: rows whose vector is not null and holds finite components alone, as integers.

    So that errors fit 64 bits, integers above 2 ** 27 (components above 32,768) take a vector out too.
    """
    v = F.col("v")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(32768.0)))
    return rows.where(whole).withColumn("v", F.transform(v, lambda x: F.floor(x * STEPS).cast("long")))


def _padded(lists: pa.ListArray, n: int, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy().reshape(n, -1)
    return np.pad(flat, ((0, 0), (0, width - flat.shape[1]))).reshape(n, PARTS, -1)


def plant_trees(rows: DataFrame, dims: int, chunk: int) -> DataFrame:
    """A row per chunk: ids, labels, and the serialised cover tree of each part position."""
    width = -(-dims // PARTS) * PARTS
    fields = CoverTree.FIELDS
    tree_kind = pa.list_(pa.struct([(k, pa.binary()) for k in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, chunk):
            parts = _padded(batch.column(2), batch.num_rows, width)
            trees = [CoverTree(parts[:, p]).to_bytes() for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(1).to_pylist()], pa.list_(pa.string())), pa.array([trees], tree_kind)], names=["ids", "labels", "trees"])

    ddl = ", ".join(f"{k}: binary" for k in fields)
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"ids array<long>, labels array<string>, trees array<struct<{ddl}>>")


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries that nothing is nearest to stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for held in batch.column("trees"):
                for p, tree in enumerate(held.as_py()):
                    s, c, _ = CoverTree.from_bytes(tree, width).assign(books[p])
                    sums[p] += s
                    counts[p] += c
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, sums.reshape(-1), counts.repeat(width))], names=["at", "total", "n"])

    out = books.copy().reshape(-1)
    # One row for each component of each entry, whatever the number of rows.
    for r in trees.select("trees").mapInArrow(run, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
        out[r["at"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def vector_codes(embeddings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector, by six Lloyd rounds from the vectors of the least ids.

    Vectors that are null, empty, hold null or non-finite components or components above 32,768 are dropped, and so are those of another
    length than the kept vector of the least id. A length that 8 doesn't divide is filled up with zeros. Null ids come last in the
    order that the first codebooks are taken in, equal ids are ordered by their vectors; repeated rows are kept. With fewer than 16
    vectors the codebooks have fewer entries. An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    spark = embeddings.sparkSession
    kept = clean_vectors(embeddings)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dims = len(first[0].v)
    kept = kept.where(F.size("v") == dims)
    width = -(-dims // PARTS)
    start = np.array([r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()], np.int64)
    books = np.pad(start, ((0, 0), (0, width * PARTS - dims))).reshape(len(start), PARTS, width).transpose(1, 0, 2)
    trees = materialise(plant_trees(kept, dims, chunk), "cover-trees")
    for _ in range(ROUNDS):
        books = lloyd_round(trees, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, held in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                n = len(ids)
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p, packed in enumerate(held.as_py()):
                    tree = CoverTree.from_bytes(packed, width)
                    entry = np.zeros(len(tree.points), np.int64)
                    for places, which in tree.assign(books[p])[2]:
                        entry[places] = which
                    codes[:, p] = entry[tree.place]
                    error += ((tree.points - books[p][entry]) ** 2).sum(1)[tree.place]
                text = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = materialise(trees.mapInArrow(encode, "vec_id long, label string, code string, error long"), "vector-codes")
    # A label may hold a large share of all rows: its one sum is laid out under several keys, so that many tasks share it.
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    sums = coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = coded.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return salted.join(sums, ["key", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
