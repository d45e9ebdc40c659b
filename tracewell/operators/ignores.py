"""Ignore patterns as rows: a join of paths with globs by literal texts, for any number of patterns.

What stands between a glob's wildcards stands in every path that it names: the first of these texts where a folder or name begins,
the last where one ends, all of them somewhere. So a glob is looked up by the beginning, the end or a gram that the fewest paths hold.
Only paths and globs that meet by such a text are compared in full. Texts are 64-bit hashes; one that two texts share costs a comparison.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.cut import cut

#: Longest gram that a glob is looked up by, and longest beginning or end, in bytes.
GRAM, REACH = 4, 256
#: Bits of the filter of the texts that any glob is looked up by: 8 MB, whatever the number of globs. More globs let more paths pass.
FILTER = 1 << 26
#: A text that more than this part of the paths holds is dealt out over so many places.
OFTEN, PLACES = 1 / 100, 64
_KEY = pa.struct([("kind", pa.int32()), ("size", pa.int32()), ("key", pa.int64())])
_PATTERN = "rule string, regex string, keys array<struct<kind:int,size:int,key:bigint>>"
_EVERY, _BEGINS, _ENDS, _HOLDS = range(4)
_PRIME, _MIX, _MASK = 0x100000001B3, 0xFF51AFD7ED558CCD, (1 << 64) - 1
_WILD = r"\[!?+\]?+[^\]]*+\]|[*?]"


def _rule_and_glob(line: str) -> tuple[str, str] | None:
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    glob, _, rule = text.rpartition(":") if ":" in text else (text, "", "*")
    glob = re.sub(r"/(?:\./)+", "/", re.sub(r"/+", "/", glob.strip())).removeprefix("./").removesuffix("/.")
    return rule.strip().upper(), glob.rstrip("/") or glob[:1] or "."


def parsed_pattern(line: str) -> tuple[str, str, list[str]] | None:
    """(rule in upper case or ``*``, regular expression of the paths, grams that stand in all of them) of a line of an ignore file.

    A line is ``glob`` or ``glob:RULE``; ``*`` crosses slashes. The glob names a whole path, the end of one behind a slash, or a folder
    with all below. Blank lines and comments give nothing.
    """
    if (parts := _rule_and_glob(line)) is None:
        return None
    rule, glob = parts
    body = re.sub(r"^\(\?s:|\)\\[Zz]$", "", fnmatch.translate(glob))
    runs = [r for r in re.split(_WILD, glob) if r]
    longest = min(GRAM, max(map(len, runs), default=0))
    grams = sorted({r[k : k + longest] for r in runs for k in range(len(r) - longest + 1)}) if longest else [""]
    return rule, f"^(?s:{body}|.*/{body}|{body}/.*)\\z", grams


def _hashed(kind: int, text: bytes) -> int:
    h = kind
    for b in text:
        h = (h ^ b) * _PRIME & _MASK
    h = (h ^ h >> 29) * _MIX & _MASK
    return h - (1 << 64) if h >> 63 else h


def lookup_keys(line: str) -> list[tuple[int, int, int]]:
    """(kind, bytes, hash) of the texts of a line that every path it names holds; of one that is all wildcards that of any path."""
    runs = [r.encode() for r in re.split(_WILD, _rule_and_glob(line)[1])]
    grams = {r[k : k + min(GRAM, len(r))] for r in runs for k in range(len(r) - min(GRAM, len(r)) + 1) if r}
    # Of runs shorter than the longest gram there is no need to ask.
    texts = [(_HOLDS, g) for g in grams if len(g) == max(map(len, grams))]
    texts += [(_BEGINS, runs[0][:REACH])] * bool(runs[0]) + [(_ENDS, runs[-1][::-1][:REACH])] * bool(runs[-1])
    return [(kind, len(t), _hashed(kind, t)) for kind, t in sorted(texts)] or [(_EVERY, 0, _hashed(_EVERY, b""))]


def texts_found(paths: pa.Array, sizes: dict[int, set[int]], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each path (its place in ``paths``) the hashes of its texts of these sizes by kind that pass the filter ``words``."""
    ends = np.frombuffer(paths.buffers()[1], np.int32)[paths.offset : paths.offset + len(paths) + 1].astype(np.int64)
    text = np.frombuffer(paths.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    owner = np.repeat(np.arange(len(paths)), ends - starts)
    slashes = np.flatnonzero(text == ord("/"))
    every = np.arange(len(paths))
    first, begun = np.concatenate([starts, slashes + 1]), np.concatenate([every, owner[slashes]])
    last, ended = np.concatenate([ends, slashes]) - 1, np.concatenate([every, owner[slashes]])
    places = {_BEGINS: (first, begun, 1), _ENDS: (last, ended, -1), _HOLDS: (np.arange(len(text)), owner, 1), _EVERY: (starts, every, 1)}
    owners, keys = [], []
    for kind, asked in sizes.items():
        at, whose, step = places[kind]
        h = np.full(len(at), kind, np.uint64)
        for size in range(max(asked) + 1):
            if size:
                inside = (at >= starts[whose]) & (at < ends[whose])
                at, whose, h = at[inside], whose[inside], h[inside]
                h = (h ^ text[at]) * np.uint64(_PRIME)
                at = at + step
            if size in asked:
                key = (h ^ h >> np.uint64(29)) * np.uint64(_MIX)
                bit = key & np.uint64(FILTER - 1)
                passes = (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                owners.append(whose[passes])
                keys.append(key[passes].view(np.int64))
    return np.concatenate([*owners, np.zeros(0, np.int64)]), np.concatenate([*keys, np.zeros(0, np.int64)])


def _found(paths: DataFrame, keys: DataFrame, counted: bool) -> DataFrame:
    """The texts of ``paths`` that are likely among ``keys`` (kind, size, key): file_path, key; or key, n, how many there are."""
    sizes: dict[int, set[int]] = {}
    for r in keys.select("kind", "size").distinct().collect():  # a few hundred at most
        sizes.setdefault(r.kind, set()).add(r.size)
    words = np.zeros(FILTER >> 6, np.uint64)
    bits = keys.select(F.col("key").bitwiseAND(FILTER - 1).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    shared = paths.sparkSession.sparkContext.broadcast(words)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(batch.column(0), pa.string())
            owner, key = texts_found(own, sizes, shared.value)
            if counted:
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])
            else:
                yield pa.RecordBatch.from_arrays([own.take(pa.array(owner)), pa.array(key, pa.int64())], names=["file_path", "key"])

    return paths.select("file_path").mapInArrow(run, "key bigint, n bigint" if counted else "file_path string, key bigint")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an ignore file, or of all in a folder, in a column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def ignored_paths(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """file_path, rule (``*`` for all): what ``patterns`` (line) name of ``paths`` (file_path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*p[:2], [dict(zip(("kind", "size", "key"), k, strict=True)) for k in lookup_keys(line)]) for line in batch.column(0).to_pylist() if line is not None and (p := parsed_pattern(line))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(_KEY)), strict=True)], names=["rule", "regex", "keys"])

    globs = patterns.select(F.col("line").cast("string").alias("line")).mapInArrow(run, _PATTERN).distinct()
    globs = cut(globs.withColumn("glob", F.monotonically_increasing_id()), "globs")
    own = cut(paths.select("file_path").where("file_path is not null").distinct(), "paths")
    asked = globs.select("glob", F.explode("keys").alias("k")).select("glob", "k.*")
    often = _found(own, asked, counted=True).groupBy("key").agg(F.sum("n").alias("n"))
    # A text that no path holds names none.
    rarest = cut(asked.join(often, "key").groupBy("glob").agg(F.min(F.struct("n", "kind", "size", "key")).alias("k")).select("glob", "k.*"), "rarest")
    most = own.count() * OFTEN
    # As a path holds few texts of a kind and size, these are few; their globs stand in several places.
    crowded = [r.key for r in rarest.where(F.col("n") > most).select("key").distinct().collect()]
    place = F.when(F.col("key").isin(crowded), F.pmod(F.xxhash64("file_path"), F.lit(PLACES)).cast("int")).otherwise(0)
    places = F.when(F.col("key").isin(crowded), F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    held = _found(own, rarest, counted=False).withColumn("place", place)
    wanted = rarest.select("glob", "key", F.explode(places).alias("place")).join(globs.select("glob", "rule", "regex"), "glob")
    return held.join(wanted, ["key", "place"]).where(F.regexp_like("file_path", F.col("regex"))).select("file_path", "rule").distinct()


def without_patterns(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings whose path and rule no line of ``patterns`` names; any case of rule ids; those without path stay."""
    named = ignored_paths(findings, patterns).groupBy(F.col("file_path").alias("i_path")).agg(F.collect_set("rule").alias("i_rules"))
    hit = F.array_contains("i_rules", "*") | F.array_contains("i_rules", F.upper("rule_id"))
    return findings.join(named, F.col("file_path") == F.col("i_path"), "left").where(~F.coalesce(hit, F.lit(False))).select(findings.columns)
