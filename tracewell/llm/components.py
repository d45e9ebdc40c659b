"""Connected components of an edge list, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._shared import materialise


def _with_least(edges: DataFrame, upwards: bool) -> DataFrame:
    """Hang the neighbours of every node on its least neighbour or itself.

    Large-star looks at both directions and moves the greater neighbours; small-star moves the smaller ones and the node.
    """
    if upwards:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        moved = near.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs) to (node, component): the least node that each node with an edge reaches.

    Loops, repeated edges and nulls are allowed and ignored; an empty table gives an empty result. Each round ends in a table
    in the shared folder, and the driver sees two numbers of it. The number of rounds grows with the logarithm of the longest
    path.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        mark = seen
        now = materialise(_with_least(_with_least(now, True), False), "edges")
