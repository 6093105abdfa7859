"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stash, unstash


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (u, v): component is the smallest node it can reach.

    Every step is a grouping and a join whose result is written to the shared
    folder; the number of steps grows with the logarithm of the longest path.
    """
    edges = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while not _stars(edges):
        for step in (_large, _small):
            found, least = step(edges)
            stars = stash(found)
            unstash(edges, least)
            edges = stars
    # an edge leads from every node to its root, which is the smallest
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: then a component is its root and what is tied to it, and no step changes anything."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root"))
    return not nodes.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("root") > 0)))).first()[0]


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours.

    The smallest ones are written first, so that the join has a plain shuffle on
    either side and Spark splits the neighbours of a hub.
    """
    both = edges.union(edges.select("v", "u"))
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stash(down.groupBy("u").agg(F.min("v").alias("m")))
    tied = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return tied.union(least.select("u", "m")).distinct(), least
