"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import stash


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """`edges` (a, b of one type) to one row (node, root) for each node that has an edge; root is the component's least node.

    Each step replaces edges by stars around local minima, so the number of edges never grows; the least neighbour comes from
    a map-side aggregate and is joined back, so a node with very many neighbours is split like any skewed join key.
    """
    edges = stash(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = stash(large)
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = large.join(low, F.col("b") == F.col("n"))
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        edges = stash(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
