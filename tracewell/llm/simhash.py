"""SimHash near-duplicates by self-joins of binary tries.

Fingerprints are keys of a binary trie. Pairs of nodes are walked together from the root, the bits in which they differ are
added up, and a pair of subtrees is dropped as soon as the error budget is exceeded. The trie is shared out over tasks with
its bits rotated: of ``budget + 1`` disjoint windows of bits, two keys within the budget agree in one at least, so it is
enough to join each subtree below a window's value with itself, once per window. Every key is sent ``budget + 1`` times, at any
size, and the windows widen with the logarithm of the number of keys, so subtrees keep their size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import bound_batches, materialise, release
from tracewell.llm.components import connected_components

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {a: a + 32 for a in range(65, 91)}
#: Keys below one window value, on average.
SUBTREE = 256


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included; of the whole sequence if it has fewer words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.empty(0, "<u8")
    parts = [" ".join(words)] if len(words) <= width else [" ".join(x) for x in zip(*(words[k:] for k in range(width)), strict=False)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(x.encode("utf-8", "surrogatepass"), 42) for x in parts], "<u8", len(parts))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of a wide hash: ``h`` itself first, then SplitMix64 steps of it."""
    if not k:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint_words(text: str | None, width: int, words: int = 1) -> np.ndarray:
    """``words`` 64-bit fingerprint words: a bit is 1 if it is set in over half of the shingle hashes; zeros for no words."""
    h = shingle_hashes(text, width)
    out = np.zeros(words, "<u8")
    if len(h):
        for k in range(words):
            bits = np.zeros(64, np.int64)
            for a in range(0, len(h), 1 << 15):
                part = np.ascontiguousarray(_mixed(h[a : a + (1 << 15)], k)).view(np.uint8).reshape(-1, 8)
                bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[k] = np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def simhash_fingerprints(docs: DataFrame, width: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (binary, ``8 * words`` bytes, little-endian words) of every whole text; null and empty texts give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_words(t, width, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp binary")


def _children(keys: np.ndarray, level: int, budget: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, diff: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs of children of the node pairs [a0, a1), [b0, b1) that the bit ``level`` of the keys leaves within the budget."""
    ones = np.r_[0, np.cumsum((keys >> np.uint64(level)) & np.uint64(1)).astype(np.int64)]
    am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
    own = a0 == b0
    children = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), tuple(v[~own] for v in (am, a1, b0, bm, diff + 1))]
    a0, a1, b0, b1, diff = (np.concatenate(v) for v in zip(*children, strict=True))
    live = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
    return tuple(v[live] for v in (a0, a1, b0, b1, diff))


def trie_self_join(groups: np.ndarray, keys: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of ``keys`` of the same group that differ in ``budget`` of their low ``bits`` bits at most, as index arrays.

    One trie per group; all are walked at once, level by level. ``groups`` and, within a group, ``keys`` must be sorted. Where
    the third value is true, both arrays are the members of two leaves of many keys, and every pair of them is meant.
    """
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.empty(0, np.int64)
    a0, a1 = starts, np.r_[starts[1:], n] if n else starts
    b0, b1, diff = a0, a1, np.zeros(len(a0), np.int8)

    def settle(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Compare the members of small node pairs outright."""
        nb = y1 - y0
        many = (x1 - x0) * nb
        which = np.repeat(np.arange(len(x0)), many)
        at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        i, j = x0[which] + at // nb[which], y0[which] + at % nb[which]
        ok = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i < j)
        return i[ok], j[ok], False

    for level in range(bits - 1, -2, -1):
        small = (a1 - a0) * (b1 - b0) <= (16 if level >= 0 else 1024)
        at = np.flatnonzero(small)
        for k in range(0, len(at), 1 << 12 if level < 0 else 1 << 17):
            some = at[k : k + (1 << 12 if level < 0 else 1 << 17)]
            yield settle(a0[some], a1[some], b0[some], b1[some])
        a0, a1, b0, b1, diff = (v[~small] for v in (a0, a1, b0, b1, diff))
        if not len(a0) or level < 0:
            break
        a0, a1, b0, b1, diff = _children(keys, level, budget, a0, a1, b0, b1, diff)
    for k in np.argsort(a0 != b0, kind="stable"):  # leaves of many equal keys, those joined with themselves first
        yield np.arange(a0[k], a1[k]), np.arange(b0[k], b1[k]), True


class Forest:
    """The least index that each of 0..n-1 reaches by the links added so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        i, j = root[i], root[j]
        while len(i):
            np.minimum.at(root, i, j)
            np.minimum.at(root, j, i)
            while not np.array_equal(up := root[root], root):
                root[:] = up
            i, j = root[i], root[j]
            open_ = i != j
            i, j = i[open_], j[open_]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        node = np.flatnonzero(self.root != np.arange(len(self.root)))
        return node, self.root[node]


def link_leaves(forest: Forest, wide: np.ndarray, x: np.ndarray, y: np.ndarray, sure_bits: int, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Add the sure links between two large leaves and give the doubtful pairs that they don't connect.

    Members that reach all of the other leaf already are not compared again.
    """
    while len(x):
        roots = np.unique(forest.root[y])
        if len(roots) == 1:
            x = x[forest.root[x] != roots[0]]
        step, x = x[:64], x[64:]
        for k in range(0, len(y) if len(step) else 0, 1 << 13):
            some = y[k : k + (1 << 13)]
            apart = np.bitwise_count(wide[step][:, None, :] ^ wide[some][None, :, :]).sum(2)
            i, j = np.nonzero(apart <= sure_bits)
            forest.add(step[i], some[j])
            i, j = np.nonzero((apart > sure_bits) & (apart <= most_bits) & (forest.root[step][:, None] != forest.root[some][None, :]))
            if len(i):
                yield step[i], some[j]


def hamming_edges(fps: DataFrame, budget: int, tables: int = 1, key_bits: int = 64, sure_bits: int | None = None, most_bits: int | None = None) -> DataFrame:
    """Edges (a, b, sure) that connect what is within the budget; fps: id (long), fp (binary).

    A trie's keys are ``key_bits`` bits of the fingerprint, from bit ``table * key_bits``, for each of ``tables``. Links are keys
    that differ in ``budget`` bits at most; with ``sure_bits`` and ``most_bits``, whole fingerprints that differ in so many bits
    at most are sure links, and doubtful ones. A task returns, for each trie it walks, a spanning forest of its sure links,
    which connects just what they connect, and all doubtful pairs that are not connected by them.
    """
    n = fps.count()
    window = max(1, min(key_bits // (budget + 1), round(math.log2(max(2, n / SUBTREE)))))
    parts = budget + 1
    kind = np.dtype("<u8") if key_bits == 64 else np.dtype("<u4")
    if key_bits not in (32, 64):
        raise ValueError("key_bits must be 32 or 64")

    def keys_of(fp: np.ndarray, t: int) -> np.ndarray:
        return np.ascontiguousarray(fp).view(kind).reshape(len(fp), -1)[:, t].astype(np.uint64)

    def rotated(keys: np.ndarray, part: int) -> np.ndarray:
        shift = np.uint64(part * window)
        if not shift:
            return keys
        turned = (keys << shift) | (keys >> (np.uint64(key_bits) - shift))
        return turned if key_bits == 64 else turned & np.uint64((1 << key_bits) - 1)

    def unpack(column: pa.Array, n: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1) if n else np.empty((0, 8 * 1), np.uint8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = unpack(batch.column(1), batch.num_rows)
            for t in range(tables if batch.num_rows else 0):
                keys = keys_of(fp, t)
                for part in range(parts):
                    top = rotated(keys, part) >> np.uint64(key_bits - window)
                    tree = ((np.uint64(t * parts + part) << np.uint64(window)) | top).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(tree), batch.column(0), batch.column(1)], names=["tree", "id", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Walk the tries that are complete: all but the last, unless nothing follows."""
            table = pa.Table.from_batches(held).combine_chunks()
            tree = table.column(0).to_numpy()
            end = len(tree) if last else int(np.searchsorted(tree, tree[-1]))
            held[:] = table.slice(end).to_batches()
            if end < 2:
                return
            tree, ids = tree[:end], table.column(1).to_numpy()[:end]
            fp = unpack(table.column(2).slice(0, end), end)
            which = tree >> window
            keys = np.zeros(end, np.uint64)
            for x in np.unique(which):
                keys[which == x] = rotated(keys_of(fp[which == x], int(x) // parts), int(x) % parts)
            order = np.lexsort((keys, tree))
            forest = Forest(end)
            wide = np.ascontiguousarray(fp).view("<u8").reshape(end, -1)
            doubtful: list[tuple[np.ndarray, np.ndarray]] = []
            sure, most = (budget, budget) if sure_bits is None else (sure_bits, most_bits)
            for i, j, leaves in trie_self_join(tree[order], keys[order], key_bits, budget):
                i, j = order[i], order[j]
                if leaves:
                    doubtful += link_leaves(forest, wide, i, j, sure, most)
                elif sure_bits is None:
                    forest.add(i, j)
                else:
                    apart = np.bitwise_count(wide[i] ^ wide[j]).sum(1)
                    forest.add(i[apart <= sure], j[apart <= sure])
                    maybe = (apart > sure) & (apart <= most)
                    doubtful.append((i[maybe], j[maybe]))
            node, root = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(ids[node]), pa.array(ids[root]), pa.array(np.ones(len(node), bool))], names=["a", "b", "sure"])
            for i, j in doubtful:
                apart = forest.root[i] != forest.root[j]
                i, j = i[apart], j[apart]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(np.zeros(len(i), bool))], names=["a", "b", "sure"])

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > 60_000:
                yield from done(False)
                rows = sum(b.num_rows for b in held)
        if held:
            yield from done(True)

    dealt = fps.select("id", "fp").mapInArrow(deal, "tree long, id long, fp binary")
    parts_n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts_n, "tree").sortWithinPartitions("tree").mapInArrow(join, "a long, b long, sure boolean")


def _classes(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """fp to component, for ``groups`` (fp, id) and the links between their ids."""
    found = connected_components(edges.select("a", "b"))
    return groups.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))


def _groups(prints: DataFrame) -> DataFrame:
    """fp, id: documents of one fingerprint are represented by the least id among them."""
    return materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprints")


def simhash_components(docs: DataFrame, width: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least id that links of ``budget`` bits or fewer reach).

    Texts without words, null ones included, have fingerprint zero and are linked like any other. Rows with equal ids keep one
    row each. A null id has a fingerprint but is nobody's least id; if no other row has its fingerprint, its component is null.
    An empty table gives no rows; extra columns are ignored.
    """
    prints = materialise(simhash_fingerprints(docs, width, 1, id_col, text_col), "simhash")
    groups = _groups(prints)
    classes = _classes(groups, hamming_edges(groups.where("id is not null"), budget))
    digits = F.lower(F.concat(*[F.substring(F.hex("fp"), k, 2) for k in range(15, 0, -2)]))  # the highest byte first
    return prints.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


#: 64-bit words of the fingerprints of ``near_duplicates``, and the bits in which two of a link may differ. Of 512 bits, bags of
#: similarity 0.8 differ in 78 with a standard deviation of 8.
FILTER_WORDS, FILTER_BITS = 8, 130
#: Words of them that a trie's rows hold, and the bits in which those may differ: as many standard deviations as above, or more.
SENT_WORDS, SENT_BITS = 4, 76
#: The chance that no trie holds both of a pair of similarity 0.8, at most; more alike ones have a smaller one.
MISSED = 1e-6
#: Shingles, each the least of a bag in an order of its own, that make a value by which tries are dealt out.
LEAST = 2
#: Keys of a trie that is dealt out once more, by windows of bits, and keys below one window value, on average.
HOT, NEAR_SUBTREE = 65536, 8192
#: Keys on each side of the nodes at which a walk compares keys outright, and of tries that are compared many at a time.
NEAR_LEAF, NEAR_SMALL = 4096, 64
#: Bits of 64 in which keys of a link may differ: four of 10,000 pairs of similarity 0.8 go beyond.
KEY_BUDGET = 20
#: Bags of fewer elements are also joined by elements. Fingerprints of those of fewer than ``TINY`` do not sort out pairs.
SMALL, TINY = 16, 6
#: Members of a region that are compared in one place, each with each; larger regions are cut into cells.
REGION = 64
#: Rows of each side of a cell in which members of a region are compared.
CELL = 1024
#: Elements that more rows of a cell have are counted by a matrix product.
OFTEN = 64
#: Rows that one broadcast holds; more are joined by shuffling.
BROADCAST = 200_000
_ROUNDING = 1e-9


class Bags:
    """Bags of shingles, as sorted 64-bit hashes; words met before are not hashed again (``limit`` of them are kept)."""

    def __init__(self, width: int, limit: int = 200_000):
        self.width, self.limit, self.known = width, limit, {}

    def bag(self, text: str | None) -> np.ndarray:
        """The second, third... occurrence of a shingle is an element of its own; fewer words than ``width`` are one shingle."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(one))
        h = np.full(len(one) - k + 1, k, np.uint64)
        for a in range(k):
            h = _mixed(h ^ one[a : len(one) - k + 1 + a], a + 1)
        h.sort()
        first = np.r_[True, h[1:] != h[:-1]]
        if first.all():
            return h
        at = np.arange(len(h))
        again = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        return np.unique(np.where(again == 0, h, _mixed(h + again * np.uint64(0xD1342543DE82EF95), 1)))


def _node(bag: np.ndarray) -> int:
    """A signed 64-bit hash of a bag, by which equal bags are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(bag.tobytes())).astype(np.int64))


def _wide_fingerprint(bag: np.ndarray) -> np.ndarray:
    """``FILTER_WORDS`` signed words; a bit is 1 if it is set in over half of the bag's hashes."""
    bits = np.zeros(64 * FILTER_WORDS, np.int64)
    for a in range(0, len(bag), 255):  # so many that sums fit a byte
        part = np.stack([_mixed(bag[a : a + 255], k) for k in range(FILTER_WORDS)], axis=1)
        bits += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * bits > len(bag), bitorder="little").view("<i8")


def values_needed(similarity: float) -> int:
    """So many values of bags that those of the similarity agree in none with a chance of ``MISSED`` at most.

    Bags have the same least element of a random order with a chance that is their similarity. The number of rows or of texts
    plays no part: texts that share few shingles hardly ever agree.
    """
    return math.ceil(math.log(MISSED) / math.log(max(1e-9, 1 - similarity**LEAST)))


def least_values(bag: np.ndarray, count: int) -> np.ndarray:
    """``count`` numbers of tries, each from the least elements of a bag in ``LEAST`` orders; the number's high bits tell which it is."""
    salt = _mixed(np.arange(1, count * LEAST + 1, dtype=np.uint64), 1)
    least = np.full(len(salt), (1 << 64) - 1, np.uint64)
    for a in range(0, len(bag), 4096):
        z = (bag[a : a + 4096, None] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        least = np.minimum(least, z.min(0))
    value = np.zeros(count, np.uint64)
    for k, part in enumerate(least.reshape(LEAST, count)):
        value = _mixed(value ^ part, k + 1)
    return _tree(np.arange(count, dtype=np.uint64), value)


def _tree(which: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The number of a trie, not negative: 11 bits of ``which`` and 52 of a hash."""
    return ((which << np.uint64(52)) | (value >> np.uint64(12))).astype(np.int64)


def _values(count: int) -> list[str]:
    return [f"v{k}" for k in range(count)]


_FP = [f"f{k}" for k in range(FILTER_WORDS)]


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few texts and what is made of them are held as Python objects at a time."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _bag_nodes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, node, size, fingerprint words and numbers of tries of every text; all but doc_id are null without words.

    few: of a bag of fewer than ``SMALL / similarity`` elements, those of which two bags that are so alike share one at least:
    in the order of hashes the first ``n - ceil(similarity * n) + 1`` of ``n``.
    """
    count = values_needed(similarity)
    names = ["node", "size", *_FP, *_values(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bags = Bags(width)
        for batch in batches:
            for some in _slices(batch):
                rows, few = [], []
                for t in some.column(1).to_pylist():
                    n = len(bag := bags.bag(t))
                    rows.append((_node(bag), n, *_wide_fingerprint(bag).tolist(), *least_values(bag, count).tolist()) if n else (None,) * len(names))
                    few.append(bag[: n - math.ceil(similarity * n - _ROUNDING) + 1].view(np.int64).tolist() if 0 < n < SMALL / similarity else None)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(few, pa.list_(pa.int64()))], names=["doc_id", *names, "few"])

    return texts.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in names)}, few array<long>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast, if it has no more ``rows`` than one holds."""
    return F.broadcast(df) if rows <= BROADCAST else df


def windows_needed(similarity: float, window: int, bits: int = 64 * FILTER_WORDS) -> int:
    """So many windows of ``window`` bits that fingerprints of the similarity agree in none with a chance of ``MISSED`` at most.

    They differ in a share of ``acos(2 s / (1 + s)) / pi`` of their bits, or a little more for some sizes of bags. Windows are
    taken as drawn at random from the same bits, so the chance is a sum over the numbers of bits that differ.
    """
    share = 1.05 * math.acos(2 * similarity / (1 + similarity)) / math.pi
    apart = np.arange(bits - window)
    log = np.array([math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log(share) + (bits - d) * math.log1p(-share) for d in apart])
    agree = np.prod([(bits - apart - k) / (bits - k) for k in range(window)], axis=0)
    count = 1
    while (np.exp(log) * (1 - agree) ** count).sum() > MISSED:
        count += 1
    return count


def trie_blocks(keys: np.ndarray, bits: int, budget: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of nodes [a0, a1), [b0, b1) of the trie of sorted ``keys`` at which the walk ends: those of ``most`` keys a side, or
    without further bits. They hold all pairs of keys that differ in ``budget`` bits at most.
    """
    a0, a1, diff = np.array([0]), np.array([len(keys)]), np.zeros(1, np.int8)
    b0, b1 = a0, a1
    for level in range(bits - 1, -2, -1):
        small = (a1 - a0 <= most) & (b1 - b0 <= most) if level >= 0 else np.ones(len(a0), bool)
        yield from zip(*(v[small].tolist() for v in (a0, a1, b0, b1)), strict=True)
        a0, a1, b0, b1, diff = (v[~small] for v in (a0, a1, b0, b1, diff))
        if not len(a0):
            return
        a0, a1, b0, b1, diff = _children(keys, level, budget, a0, a1, b0, b1, diff)


def connecting(forest: Forest, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """So many of the pairs as connect what all of them connect in the forest, to which they are added: up to four for each merger."""
    found = []
    while len(i):
        roots = forest.root[i], forest.root[j]
        apart = roots[0] != roots[1]
        i, j = i[apart], j[apart]
        if len(i):
            pick = np.unique(np.r_[np.unique(roots[0][apart], return_index=True)[1], np.unique(roots[1][apart], return_index=True)[1]])
            found.append((i[pick], j[pick]))
            forest.add(i[pick], j[pick])
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (i, j)


def near_links(keys: np.ndarray, wide: np.ndarray, size: np.ndarray, budget: int, similarity: float, most: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of one trie's sorted ``keys`` that connect what its pairs within all bounds connect.

    Bounds: ``budget`` bits of the key, ``most`` of the fingerprint words in ``wide``, sizes that allow the similarity.
    Keys that are connected to most of the others already are not compared with those again.
    """
    forest, found = Forest(len(keys)), []
    for a0, a1, b0, b1 in trie_blocks(keys, 64, budget, NEAR_LEAF):
        for at in range(a0, a1, 128):
            x, y = np.arange(at, min(at + 128, a1)), np.arange(at if a0 == b0 else b0, b1)
            root = forest.root.copy()
            held = np.bincount(root[y])
            sides = [(x, y)]
            if held.max() > 1:
                top = held.argmax()
                sides = [(x[root[x] != top], y), (x[root[x] == top], y[root[y] != top])]
            for u, v in sides:
                i, j = np.nonzero(np.bitwise_count(keys[u][:, None] ^ keys[v][None, :]) <= budget)
                i, j = u[i], v[j]
                fit = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - _ROUNDING)
                i, j = i[fit], j[fit]
                near = (np.minimum(size[i], size[j]) < TINY) | (np.bitwise_count(wide[i] ^ wide[j]).sum(1) <= most)
                found.append(connecting(forest, i[near], j[near]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def small_links(starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, wide: np.ndarray, size: np.ndarray, budget: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``near_links``, for many small tries at once, whose keys are at ``starts`` to ``ends``; each has its own ``budget``."""
    many = ends - starts
    row = np.repeat(starts, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    after, allowed = np.repeat(ends, many) - row - 1, np.repeat(budget, many)
    upto, forest, found = np.cumsum(after), Forest(len(keys)), []
    for a, b in zip(cuts := np.unique(np.r_[0, np.searchsorted(upto, np.arange(1 << 18, upto[-1] if len(upto) else 0, 1 << 18)), len(row)]), cuts[1:], strict=False):
        own = after[a:b]
        i = np.repeat(row[a:b], own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        fit = (np.bitwise_count(keys[i] ^ keys[j]) <= np.repeat(allowed[a:b], own)) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - _ROUNDING)
        i, j = i[fit], j[fit]
        near = (np.minimum(size[i], size[j]) < TINY) | (np.bitwise_count(wide[i] ^ wide[j]).sum(1) <= most)
        found.append(connecting(forest, i[near], j[near]))
    return tuple(np.concatenate([np.empty(0, np.int64), *(pair[k] for pair in found)]) for k in (0, 1))


def hot_tries(nodes: DataFrame, count: int) -> DataFrame:
    """tree and window: tries of more than ``HOT`` keys, and the bits of a window that leave ``NEAR_SUBTREE`` of them."""
    trees = nodes.select(F.explode(F.array(*_values(count))).alias("tree")).withColumn("some", F.pmod("tree", F.lit(65536)))
    full = trees.groupBy("some").count().where(F.col("count") > HOT).select("some")  # a few sums tell where none can be
    counted = trees.join(F.broadcast(full), "some").groupBy("tree").count().where(F.col("count") > HOT)
    return counted.select("tree", F.expr(f"cast(greatest(1, least(24, round(log2(count / {NEAR_SUBTREE})))) as int)").alias("window"))


def near_pairs(nodes: DataFrame, few: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that connect whatever may have the similarity, by self-joins of tries.

    ``nodes``: node, size, fingerprint words and numbers of tries; ``few``: the same and an element, for small bags. A trie holds
    64 bits of the fingerprints of all bags that share a value (``least_values``) and is joined with itself; the values are so
    many that pairs of the similarity agree in one but for a chance of ``MISSED``. So a node makes as many rows at any size
    of the table. Small bags' elements are such values too. A row holds ``SENT_WORDS`` words of the fingerprint, the key first,
    which are others for each value. A trie of more than ``HOT`` keys (of a passage that many texts share) is dealt out once
    more, by windows of those bits, in which pairs of the similarity agree somewhere with the same chance; these windows
    become more as such a trie grows. A trie gives fewer pairs than four times its keys.
    """
    spark, count, bits = nodes.sparkSession, values_needed(similarity), 64 * SENT_WORDS

    def words_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(2 + k).to_numpy() for k in range(FILTER_WORDS)], axis=1)

    def sent(words: np.ndarray, k: int) -> pa.Array:
        some = np.ascontiguousarray(words[:, (k + np.arange(SENT_WORDS)) % FILTER_WORDS])
        return pa.Array.from_buffers(pa.binary(8 * SENT_WORDS), len(some), [None, pa.py_buffer(some)]).cast(pa.binary())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for batch in batches for some in _slices(batch, 2000)):
            words = words_of(batch)
            for k in range(count):
                yield pa.RecordBatch.from_arrays([batch.column(2 + FILTER_WORDS + k), batch.column(0), batch.column(1), sent(words, k)], names=["tree", "node", "size", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, np.ndarray] = {}
        for batch in (some for batch in batches for some in _slices(batch, 2000)):
            yield batch.filter(pc.is_null(batch.column(4))).select(["tree", "node", "size", "fp"])
            for window in batch.column(4).drop_null().unique().to_pylist():
                if window not in places:
                    each, needed = bits // window, windows_needed(similarity, window, bits)
                    places[window] = np.concatenate([np.random.default_rng(k).permutation(bits)[: each * window].reshape(each, window) for k in range(-(-needed // each))])[:needed]
                hot = batch.filter(pc.fill_null(pc.equal(batch.column(4), window), False))
                own = np.unpackbits(np.frombuffer(b"".join(hot.column(3).to_pylist()), np.uint8).reshape(hot.num_rows, -1), axis=1, bitorder="little")
                tree, weight = hot.column(0).to_numpy().astype(np.uint64), (1 << np.arange(window)).astype(np.uint64)
                for k, at in enumerate(places[window]):
                    value = _mixed(tree ^ _mixed(own[:, at] @ weight, k + 1), 1)
                    yield pa.RecordBatch.from_arrays([pa.array(_tree(tree >> np.uint64(52), value)), *hot.columns[1:4]], names=["tree", "node", "size", "fp"])

    def deal_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree = pa.array(batch.column(2 + FILTER_WORDS).to_numpy() | np.int64(-(1 << 63)))  # no value's, as those are positive
            yield pa.RecordBatch.from_arrays([tree, batch.column(0), batch.column(1), sent(words_of(batch), 0)], names=["tree", "node", "size", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Join the tries that are complete: all but the last, unless nothing follows."""
            table = pa.Table.from_batches(held).combine_chunks()
            tree, node, size = (table.column(k).to_numpy() for k in range(3))
            end = len(tree) if last else int(np.searchsorted(tree, tree[-1]))
            held[:] = [table.slice(end).combine_chunks().to_batches()[0]] if end < len(tree) else []
            if not end:
                return
            wide = np.frombuffer(b"".join(table.column(3).slice(0, end).to_pylist()), "<u8").reshape(end, -1)
            starts = np.flatnonzero(np.r_[True, tree[1:end] != tree[: end - 1]])
            ends = np.r_[starts[1:], end]
            budget = np.where(tree[starts] >= 0, KEY_BUDGET, 64)
            small = ends - starts <= NEAR_SMALL
            i, j = small_links(starts[small], ends[small], wide[:, 0], wide, size[:end], budget[small], similarity, SENT_BITS)
            out = [(node[i], node[j])]
            for a, b, most in zip(starts[~small].tolist(), ends[~small].tolist(), budget[~small].tolist(), strict=True):
                keys = wide[a:b, 0]
                order = np.argsort(keys, kind="stable")
                at = a + order
                i, j = near_links(keys[order], wide[at], size[at], most, similarity, SENT_BITS)
                out.append((node[at[i]], node[at[j]]))
            x, y = (np.concatenate(v) for v in zip(*out, strict=True))
            if len(x):
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > 60_000:
                yield from done(False)
                rows = sum(b.num_rows for b in held) // 2  # a large trie is put together at each doubling alone
        if held:
            yield from done(True)

    kind, columns = "tree long, node long, size int, fp binary", ["node", F.col("size").cast("int"), *_FP]
    dealt = nodes.select(*columns, *_values(count)).mapInArrow(deal, kind)
    if nodes.count() > HOT:
        hot = materialise(hot_tries(nodes, count), "hot-tries")
        if hot.take(1):
            dealt = dealt.join(F.broadcast(hot), "tree", "left").select("tree", "node", "size", "fp", "window").mapInArrow(split, kind)
    dealt = dealt.unionByName(few.select(*columns, "element").mapInArrow(deal_few, kind))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "tree").sortWithinPartitions("tree")
    return sorted_.mapInArrow(join, "a long, b long").where("a <> b").distinct()


def linked_pairs(x: list[np.ndarray], y: list[np.ndarray], allowed: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` of pairs of sets that connect just what the allowed pairs of the similarity connect.

    A link may be too many where elements that were cut to 32 bits meet, none is too few.
    """
    size = np.array([len(v) for v in [*x, *y]])
    row, element = np.repeat(np.arange(len(size)), size), np.concatenate([*x, *y])
    lost = np.zeros(len(size), np.int64)  # elements of one bag that are equal now
    order = np.lexsort((element, row))
    row, element = row[order], element[order]
    same = np.r_[False, (row[1:] == row[:-1]) & (element[1:] == element[:-1])]
    np.add.at(lost, row[same], 1)
    row, element = row[~same], element[~same]
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    row, column = row[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = (lost[: len(x), None] + lost[None, len(x) :]).astype(np.float32)
    often = np.bincount(column)[column] > OFTEN
    held = np.zeros((len(size), len(dense := np.unique(column[often]))), np.float32)
    held[row[often], np.searchsorted(dense, column[often])] = 1
    for a in range(0, len(dense), 4096):
        common += held[: len(x), a : a + 4096] @ held[len(x) :, a : a + 4096].T
    row, column = row[~often], column[~often]
    mine, theirs = row < len(x), row >= len(x)
    first = np.searchsorted(column[theirs], column[mine])  # each of the other side's rows with this element
    many = np.searchsorted(column[theirs], column[mine], "right") - first
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
    place = np.repeat(row[mine], many) * len(y) + row[theirs][at] - len(x)
    common += np.bincount(place, minlength=common.size).reshape(common.shape)
    i, j = np.nonzero(allowed & (common >= similarity / (1 + similarity) * (size[: len(x), None] + size[None, len(x) :]) - 1e-3))
    i, j = connecting(Forest(len(size)), i, len(x) + j)
    return i, j - len(x)


def region_pairs(regions: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) that connect what links inside a region connect; ``regions``: node, region.

    Members whose label is not their region's most frequent one meet all others, in cells of about ``CELL`` rows a side, where
    whole bags of 32-bit elements are compared. A cell returns no more pairs than it has rows.
    """
    labelled = regions.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = labelled.groupBy("region", "label").count().groupBy("region").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("n"), F.max("count").alias("m"))
    counted = materialise(counted.where("n > m"), "counted")
    members = labelled.join(_small(counted, counted.count()), "region")
    wanted = members.join(nodes.select("node", F.col("id").alias("doc_id")), "node").select("node", "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(width)
        for batch in (some for batch in batches for some in _slices(batch)):
            made = [bags.bag(t) for t in batch.column(1).to_pylist()]
            right = pa.array([_node(b) == node for b, node in zip(made, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            rows = pa.array([b.astype("<u4").tobytes() for b in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(right), rows.filter(right)], names=["node", "bag"])

    found = texts.join(_small(wanted, wanted.count()), "doc_id").select("node", "text").mapInArrow(cut, "node long, bag binary").dropDuplicates(["node"])
    members = members.join(found, "node")
    mine, theirs = (F.greatest(F.lit(1), F.ceil(F.expr(n) / CELL)).cast("int") for n in ("n - m", "n"))
    x = members.where("label <> most").select("region", F.pmod(F.xxhash64("node", F.lit(1)), mine).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), theirs - 1)).alias("q"), F.lit(True).alias("left"), "node", "label", "most", "bag")
    y = members.select("region", F.explode(F.sequence(F.lit(0), mine - 1)).alias("p"), F.pmod(F.xxhash64("node"), theirs).cast("int").alias("q"), F.lit(False).alias("left"), "node", "label", "most", "bag")

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        x, y = cell[cell.left], cell[~cell.left]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, np.int64)
        a, b = x.node.to_numpy(), y.node.to_numpy()
        own, other = x.label.to_numpy()[:, None], y.label.to_numpy()[None, :]
        allowed = (own != other) & ((other == y.most.iloc[0]) | (a[:, None] < b[None, :]))
        i, j = linked_pairs(*([np.frombuffer(v, "<u4") for v in side.bag] for side in (x, y)), allowed, similarity)
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])})

    return x.unionByName(y).groupBy("region", "p", "q").applyInPandas(meet, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two bags' Jaccard similarity is ``similarity`` or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - _ROUNDING:
        return False
    both = np.sort(np.r_[x, y], kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - _ROUNDING


def region_links(regions: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of the similarity that connect what such pairs inside a region connect; ``regions``: node, region.

    For regions of few members: their texts are dealt out by region, each once, and a task holds the bags of one region at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bags = Bags(width)
        region, held = None, {}

        def links() -> list[tuple[int, int]]:
            found, label = [], {node: node for node in held}
            for b, y in held.items():
                for a, x in held.items():
                    if a == b:
                        break
                    if label[a] != label[b] and similar(x, y, similarity):
                        found.append((a, b))
                        gone = label[b]
                        label = {node: label[a] if at == gone else at for node, at in label.items()}
            return found

        for batch in (some for batch in batches for some in _slices(batch)):
            found = []
            for at, node, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at != region:
                    found += links()
                    region, held = at, {}
                if node not in held and _node(bag := bags.bag(text)) == node:
                    held[node] = bag
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = links()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    wanted = regions.join(nodes.select("node", F.col("id").alias("doc_id")), "node")
    found = texts.join(_small(wanted, regions.count()), "doc_id").select("region", "node", "text")
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose bags' Jaccard similarity is ``similarity`` or more.

    ``nodes``: node and the id of a text of it; ``texts``: doc_id, text. Rows that repeat the id with another text are told
    apart by the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(width)
        for batch in (some for batch in batches for some in _slices(batch)):
            near = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = bags.bag(x), bags.bag(y)
                near.append(similar(x, y, similarity) and _node(x) == a and _node(y) == b)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("id").alias("doc_id")), "node")
    found = texts.join(_small(wanted, 2 * pairs.count()), "doc_id").select("node", "text").distinct()  # texts of no pair are not shuffled
    x, y = (found.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def large_region_links(tried: DataFrame, regions: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """As ``region_links``, for regions of any number of members: the pairs tried inside them first, then cells of those still apart."""
    tried = materialise(tried.join(regions.select(F.col("node").alias("a")), "a").select("a", "b"), "pairs")
    found = materialise(alike(tried, nodes, texts, width, similarity), "links")
    labels = materialise(connected_components(found).toDF("node", "label"), "labels")
    pairs = materialise(region_pairs(regions, nodes, labels, texts, width, similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(alike(pairs, nodes, texts, width, similarity))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of documents that links of Jaccard similarity ``similarity`` or more connect.

    Bags of word shingles are compared, so repeats count. Fingerprints of 512 bits are joined in tries (``near_pairs``), one for all
    bags with the same least shingles, and what their pairs connect is a region. The members of a region of ``REGION`` or fewer are compared with each other by exact
    similarity, where they are not connected yet. In larger regions each pair is verified first; members that are still apart are
    compared in cells, and these links are verified too. A pair of similarity 0.8 shares no region with a chance of
    ``MISSED``, and one that differs in more than ``SENT_BITS`` bits of those sent is rarer still.

    Equal bags are one class from the start. Nulls, repeats and empty tables: as in ``simhash_components``, but a text without
    words is like no other and stands alone.
    """
    bound_batches(docs.sparkSession)
    everything = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialise(_bag_nodes(everything, width, similarity), "bags")
    texts, compared = everything.where("doc_id is not null"), prints.where("node is not null and doc_id is not null")
    first = [F.first(c).alias(c) for c in ["size", *_FP, *_values(values_needed(similarity))]]  # equal for all rows of a node
    nodes = materialise(compared.groupBy("node").agg(F.min("doc_id").alias("id"), *first), "nodes")
    few = compared.where("few is not null").select("node", "size", *_FP, F.explode("few").alias("element")).distinct()
    tried = materialise(near_pairs(nodes, few, similarity), "pairs")
    regions = materialise(connected_components(tried).toDF("node", "region"), "regions")
    large = materialise(regions.groupBy("region").count().where(F.col("count") > REGION).select("region"), "large-regions")
    number = large.count()
    found = region_links(regions.join(_small(large, number), "region", "left_anti"), nodes, texts, width, similarity)
    if number:
        many = materialise(regions.join(_small(large, number), "region", "left_semi"), "regions")
        found = found.unionByName(large_region_links(tried, many, nodes, texts, width, similarity))
    labels = materialise(connected_components(found).toDF("node", "label"), "labels")
    labelled = nodes.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    classes = labelled.join(least, "label").select("node", "component_id")
    return prints.join(classes, "node", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
