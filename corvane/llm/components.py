"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014).

Every step is an aggregation and an equi-join, in which nodes of very many links get theirs by a broadcast; labels and links stay distributed. Each round's links
are written to the shared folder, so the plan does not grow and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_split, tidy, written


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node to the node's smallest; `n`: the number of links."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    out = join_split(both, least, ["a"], "n", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(  # a hot node's rows are many, the other side's is one: adaptive execution splits them
        F.col("b").alias("a"), F.col("m").alias("b")
    ).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b: of any type with an order, not null) but the components' smallest nodes.

    A component is named by its smallest node. Ends when a round changes nothing.
    """
    links = written(links.filter("a <> b").distinct())
    mark = None
    while True:
        n, s = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == mark or not n:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = (n, s)
        links = written(_small_star(_large_star(links, n)))
        tidy(links.sparkSession)
