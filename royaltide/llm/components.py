"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    """Order-free digest that tells whether a round changed any edge."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node.

    Each round links the neighbours of a node to their smallest one, in both
    directions of the label order, which halves the depth of the trees. Edges stay
    distributed; only a count and a digest of them reach the driver. A node
    with many neighbours is handled by hash aggregation and a join on the node, not
    gathered.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(), "links")
    mark = _mark(current)
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(
                F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
            )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        )
        current = stored(small, "links")
        seen, mark = mark, _mark(current)
        if seen == mark:
            break
    else:
        raise RuntimeError(f"components not finished after {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
