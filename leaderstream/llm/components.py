"""Connected components of links between numbered things, by alternating large-star and small-star.

Large-star ties the larger neighbours of a node to the least of its neighbourhood, small-star the smaller ones. Both
keep what is connected connected; in the end every node hangs on the least of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its least reachable node, for each node but the least ones themselves.

    ``links`` has two columns of one number type, in either order; repeats, links of a node with
    itself and NULLs do nothing. Rounds grow with the logarithm of the number of links. Minima are written
    before they meet their links, so that Spark can split the links of a hub.
    """
    first, second = links.columns
    edges = links.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    edges = kept(edges.where((F.col(first) != F.col(second))).distinct(), "components")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")), "components-large")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select("v", F.least("m", "u").alias("m"))
        large = kept(large.distinct().toDF("a", "b"), "components-star")
        least = kept(large.groupBy("a").agg(F.min("b").alias("m")), "components-small")
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select("b", "m")
        edges = kept(least.select("a", "m").unionAll(small.toDF("a", "m")).distinct().toDF("a", "b"), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
