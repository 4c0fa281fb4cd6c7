"""Connected components by alternating star contraction (Kiveris et al., SoCC 2014).

Neighbourhoods are never collected: each step takes a minimum per node, which combines on the
map side, and joins it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.session import cut


def _canonical(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, each once."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.inline(ends))
    lowest = both.groupBy("a").agg(F.min("b").alias("m"))
    lowest = lowest.withColumn("m", F.least("a", "m"))
    return (
        both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b")))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two parents or is both child and root.

    Connectivity never changes, so once neither happens each component is one star around its
    smallest node. This is cheaper than a round that finds nothing left to move.
    """
    roots = edges.select(F.col("b").alias("a")).distinct().withColumn("root", F.lit(True))
    children = edges.groupBy("a").agg(F.count(F.lit(1)).alias("parents"))
    return bool(children.join(roots, "a", "left").filter("parents > 1 or root").head(1))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node.

    After one small star, a node below which nothing hangs has one parent and changes nothing for
    the others. It waits for its parent's root, so the rounds run over the other nodes only.
    """
    first = cut(_canonical(edges))
    lowest = cut(first.groupBy("a").agg(F.min("b").alias("m")))
    above = cut(first.select(F.col("b").alias("a")).distinct())
    leaves = lowest.join(above, "a", "left_anti").select("a", "m")
    # Hubs of one leaf meet through it, an inner node keeps its own edge.
    met = first.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    inner = lowest.join(above, "a", "left_semi").select("a", F.col("m").alias("b"))
    current = cut(_canonical(met.unionByName(inner)))
    while _unsettled(current):
        current = cut(_canonical(_small_star(_canonical(_large_star(current)))))
    roots = current.select(F.col("a").alias("m"), F.col("b").alias("root"))
    hung = leaves.join(roots, "m", "left").select(F.col("a").alias("node"), F.coalesce("root", "m").alias("root"))
    own = above.join(current.select("a"), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return hung.unionByName(roots.withColumnRenamed("m", "node")).unionByName(own)
