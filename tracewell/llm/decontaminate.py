"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``rate`` of its length in edits. Cut into one piece more than that budget, one
piece at least must occur unchanged. One automaton finds the exact hits of all pieces in a linear pass over the whole text;
around each hit Myers' bit-parallel algorithm computes the least edit distance between the item and any stretch of text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import bound_batches, release

#: Characters of items that one broadcast holds; more items are matched in blocks.
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, each run of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    return dict(masks)


def myers_distance(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any stretch of ``text``, and where the first such stretch ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for k, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        score += bool(up & high) - bool(down & high)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(zero | up) & full, up & zero
        if score < best:
            best, end = score, k
    return best, end


class ItemMatcher:
    """Finds in a text the items that occur with no more edits than their budget."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t)), pattern_masks(t)) for i, t in items]
        where: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)  # the least and greatest offset in each item
        for k, (_, text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                where[piece][k] = (where[piece].get(k, (offset,))[0], offset)
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), [(k, *offsets) for k, offsets in at.items()]))
        if where:
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item found, at its least distance, first place first."""
        text, best = normalise(text), {}
        tried: dict[int, list[tuple[int, int]]] = {}  # ranges of the text, but those that end before the hit
        if not self.items:
            return []
        for last, (length, at) in self.automaton.iter(text):
            for k, least, greatest in at:
                start = last + 1 - length
                _, item, budget, masks = self.items[k]
                if k in best and best[k][0] == 0:
                    continue
                if not budget:  # the piece is the item
                    best[k] = (0, last + 1)
                    continue
                left, right = max(0, start - greatest - budget), start - least + len(item) + budget
                if k in tried and any(a <= left and min(right, len(text)) <= b for a, b in tried[k]):
                    continue
                a, b = left, right + budget
                distance, end = myers_distance(masks, len(item), text[a:b])
                tried[k] = [(x, y) for x, y in tried.get(k, ()) if y > last] + [(a, min(b, len(text)))]
                if distance <= budget and (k not in best or distance < best[k][0]):
                    best[k] = (distance, a + end)
        return [(self.items[k][0], d, e) for k, (d, e) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, block after block of about ``most_chars``; those without text are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // most_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if found := sorted((r.item_id, t) for r in rows if (t := normalise(r.text))):
            yield found


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end: the items that occur in each document, with the least number of edits found.

    ``rate`` is the edit budget as a share of the item's normalised length (case and runs of white space don't count); ``end``
    is where the stretch ends in the normalised text. Items that are null or without text match nothing; items of the same
    text are all reported. Null and empty texts hold nothing; repeated rows are reported each; an empty table on either side
    gives no rows; extra columns are ignored.
    """
    spark, out = docs.sparkSession, None
    bound_batches(spark)
    schema = "doc_id long, item_id long, distance int, end long"
    for block in item_blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            matcher = ItemMatcher(shared.value, rate)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for hit in matcher.match(text)]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "end"])

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)
