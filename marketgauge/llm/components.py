"""Connected components of a graph of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links` (a, b): the smallest node it can reach.

    Large-star and small-star rounds: a node passes its smallest neighbour to its larger, then to
    its smaller ones, until all links are stars about their smallest node. Minima are found by
    sums before the exchange and joined back, so no task holds a node's whole neighbourhood; the
    links of each round are written to the shared folder.
    """
    edges = cut(ordered(links))
    while not stars(edges):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"),
                                                             F.col("m").alias("b"))
        edges = cut(ordered(large))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
        edges = cut(ordered(small))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())


def ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller one."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                         F.least("a", "b").alias("b")).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether each larger node has one link, to a node that is no larger node itself."""
    several = edges.groupBy("a").count().filter("count > 1").select("a")
    between = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return several.union(between).isEmpty()
