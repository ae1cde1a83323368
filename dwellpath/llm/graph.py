"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.llm.spark import forget, stored


#: Edges are far fewer than the rows that shuffle partitions are set for.
SHARE = 8


def _is_forest(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge straight to a root."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reached.

    Nodes are longs. Loops, repeated edges and nulls don't matter. Neighbourhoods are aggregated to
    their minimum and joined back by node; a node of very many edges is one key of that join, which
    Spark's skew join splits, as the other side has one row for it.
    Raises where the rounds run out before all components are whole.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = stored(e, share=SHARE)
    for _ in range(max_rounds):
        if _is_forest(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: each larger neighbour goes to the node's minimum
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each smaller neighbour, and the node itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        before, e = e, stored(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), share=SHARE)
        forget(before)
    else:
        if not _is_forest(e):
            raise RuntimeError(f"components are not whole after {max_rounds} rounds")
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = ends.select(F.col("component").alias("node"), "component").distinct()
    return ends.unionByName(roots)
