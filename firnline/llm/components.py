"""Connected components by alternating large-star and small-star, all edges staying in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import dealt_anew, discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(dealt_anew(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them. Edges go from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(dealt_anew(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) for every node with an edge to another.

    Both stars keep components and end in one star around the smallest node of each, after about log^2 rounds at most.
    That is so once no node has two smaller neighbours and no smaller neighbour has one itself. A round's sums are made
    before rows are dealt out, and the many edges of a star's middle can be dealt over several tasks; edges are written to the shared folder each round. Edges of a node to itself and repeated
    ones change nothing; without edges there are no rows.
    """
    larger, smaller = F.greatest(a, b), F.least(a, b)
    current = materialise(edges.where(F.col(a) != F.col(b)).select(larger.alias("u"), smaller.alias("v")).distinct(), "edges")
    while not _is_starry(current):
        before, current = current, materialise(_small_star(_large_star(current)).distinct(), "edges")
        discard(before)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_starry(edges: DataFrame) -> bool:
    """Whether each edge leads to the middle of a star. Edges are distinct."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()
