"""Document fingerprints: bottom-k sketches of word shingles, by Spark's own functions.

A sketch is the ``k`` least distinct hashes of a text's shingles, ascending. A hash is the first 13 hex digits (52 bits) of the
shingle's MD5, so sketches sort as text and numbers drawn from them are exact doubles. Sketches merge: the sketch of several parts is
the ``k`` least of theirs. From two of them come resemblance and containment, from one the number of distinct shingles; below ``k``
shingles all of it is exact.

Words are the maximal runs of anything but ASCII white space, A to Z in lower case. A text of fewer words than a shingle has one
shingle of them all; a text without words has none, and so the empty sketch.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle, hashes of a sketch, hex digits of a hash.
WORDS, SIZE, DIGITS = 5, 128, 13
#: Ranges of ids per shuffle partition; more of them even out what a task gets.
RANGES = 8
_SPACES = "\t\n\x0b\x0c\r"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, though ``body`` names it often or inside a function of its own."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    plain = F.translate(text, ascii_uppercase + _SPACES, ascii_lowercase + " " * len(_SPACES))
    return F.array_remove(F.split(plain, " "), "")


def sketch(text: Column, n_words: int = WORDS, size: int = SIZE) -> Column:
    """The sketch of a text as an array of hashes, ascending; null counts as empty."""

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n_words, F.lit(0)))
        shingle = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n_words)])
        every = F.transform(starts, lambda i: F.left(F.md5(shingle(i).cast("binary")), F.lit(DIGITS)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(least(every, size))

    return bound(words(F.coalesce(text, F.lit(""))), hashes)


def least(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``size``."""
    share = F.conv(F.element_at(a, -1), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.lit(size - 1.0) / share)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of either that both have; 1 for two texts without words."""
    both = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.greatest(F.size(u), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(bound(merged(a, b, size), both))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too, 1 at most; 1 for an ``a`` without words."""
    union = distinct_shingles(merged(a, b, size), size)
    share = resemblance(a, b, size) * union / distinct_shingles(a, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_text(a: Column) -> Column:
    return F.array_join(a, "")


def group_sketches(sketches: DataFrame, keys: list[str], column: str = "sketch", size: int = SIZE, salts: int = 64) -> DataFrame:
    """keys, ``column``: the sketch of all texts of each group, by any number of rows.

    A group is first cut down to ``size`` hashes in each of ``salts`` parts, so that no task gets a large group whole.
    """
    own = [F.col(f"`{k}`") for k in keys]
    rows = sketches.select(*own, F.explode_outer(column).alias("__hash")).distinct().withColumn("__salt", F.pmod(F.xxhash64("__hash"), F.lit(salts)))
    cut = Window.partitionBy(*own, "__salt").orderBy("__hash")
    few = rows.withColumn("__rank", F.row_number().over(cut)).where(F.col("__rank") <= size)
    return few.groupBy(*own).agg(least(F.collect_list("__hash"), size).alias(column))


def id_bounds(docs: DataFrame, column: str, ranges: int) -> list[int]:
    """Where ranges of ids of about equally many rows begin; each is an id of the table, the first the least one."""
    found = docs.agg(F.min(column).alias("first"), F.percentile_approx(column, [k / ranges for k in range(1, ranges)] or [0.5], F.lit(20 * ranges + 10_000)).alias("others")).first()
    return sorted({found.first, *(found.others or [])}) if found.first is not None else []


def with_next(docs: DataFrame, id_col: str, columns: list[str], ranges: int) -> tuple[DataFrame, Window]:
    """Rows dealt out by range of id, each range with the first rows of the next (``__guest``) behind its own, and the window over a
    range in ascending order; the next range of the last is the first.

    Rows with equal ids are in the order of ``columns``; they share a range. Null ids come first.
    """
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)))
    bounds = id_bounds(docs.select(key.alias("__key")), "__key", ranges)
    starts = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    n = max(1, len(bounds))
    # The range by halving: the last start that isn't above the key.
    step = lambda at, half: F.when((at + half < n) & (F.get(starts, at + half) <= F.col("__key")), at + half).otherwise(at)
    halves = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    own = F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), step)
    rows = docs.withColumn("__key", key).withColumn("__own", own)
    is_start = F.get(starts, F.col("__own")) == F.col("__key")
    before = F.pmod(F.col("__own") - 1, F.lit(n))
    places = F.when(is_start, F.array(F.struct(F.lit(False).alias("guest"), F.col("__own").alias("range")), F.struct(F.lit(True).alias("guest"), before.alias("range"))))
    places = places.otherwise(F.array(F.struct(F.lit(False).alias("guest"), F.col("__own").alias("range"))))
    dealt = rows.withColumn("__place", F.explode(places)).select(*docs.columns, F.col("__place.guest").alias("__guest"), F.col("__place.range").alias("__range"))
    return dealt, Window.partitionBy("__range").orderBy("__guest", F.col(id_col).asc_nulls_first(), *columns)


def fingerprint_edits(docs: DataFrame, n_words: int = WORDS, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_kept, n_shingles of each text.

    The edited text ends in the first code points of the next document in place of its own last quarter; after the last document
    comes the first, so a single document is its own next one. ``near_*`` are estimated resemblances, ``edited_kept`` the estimated
    containment of the text in the edited one, ``n_shingles`` the estimated number of distinct shingles. Texts are shuffled once.

    A null text counts as empty. Null ids come first; of rows with equal ids the order is that of their texts; repeated rows are
    kept. An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, order = with_next(rows, "doc_id", ["text"], RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_chars = F.char_length("text")
    quarter = F.floor(n_chars / 4).cast("int")
    following = dealt.withColumn("next_text", F.lead("text").over(order))
    edited = F.concat(F.left(F.col("text"), n_chars - quarter), F.left(F.coalesce("next_text", F.lit("")), quarter))
    made = following.withColumn("edited", edited).withColumn("sketch", sketch(F.col("text"), n_words, size))
    made = made.select("doc_id", "text", "__guest", "__range", n_chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", F.when(~F.col("__guest"), sketch(F.col("edited"), n_words, size)).alias("edited_sketch"))
    made = made.withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("__guest"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"), resemblance(a, b, size).alias("near_edited"),
        resemblance(a, c, size).alias("near_next"), containment(a, b, size).alias("edited_kept"), distinct_shingles(a, size).alias("n_shingles"),
    )
