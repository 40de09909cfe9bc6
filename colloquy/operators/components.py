"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut_lineage


def _settled(edges: DataFrame) -> bool:
    """Every node points at one root, and no root points anywhere."""
    torn = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return torn.unionByName(chained).limit(1).isEmpty()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Point neighbours at the least node around them.

    A node's least neighbour is one aggregate row.  It is written out before it
    is joined back: then both sides of the join are shuffled for it, and adaptive
    execution can split the edges of a hub."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
        moved = (
            edges.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node on an edge ``(a, b)``; the root is the
    least node of its component.  Rounds grow with the logarithm of the size,
    and each ends in a reliable checkpoint."""
    current = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    for _ in range(max_rounds):
        if _settled(current):
            break
        current = cut_lineage(_star(_star(current, larger=True), larger=False))
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = leaves.select(F.col("root").alias("node"), "root").distinct()
    return leaves.unionByName(roots)
