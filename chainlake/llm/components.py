"""Connected components by alternating large-star and small-star rounds.

Each round is two hash aggregations (min per node, combined before the
shuffle) and two equi-joins that adaptive execution may split at a hub, so a
component that holds most nodes neither meets in one task nor reaches the
driver.  The number of rounds grows with the logarithm of the largest
component.  Every round is cut off through the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, until_stable


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("b"), F.col("m").alias("a")).where("a < b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them (a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return (joined.select(F.col("a").alias("b"), F.col("m").alias("a")).where("a < b")
            .unionByName(least.select("b", F.col("m").alias("a"))).distinct())


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in ``pairs`` (a, b BIGINT); root is the smallest node.

    Loops and repeated or reversed pairs are allowed; pairs with a null end are
    ignored; an empty input gives an empty result.  Nodes that occur in no
    pair are not returned: they are their own root.
    """
    edges = cut_lineage(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a is not null and b is not null and a < b").distinct())
    stars = until_stable(lambda e: _small_star(_large_star(e)).select("a", "b"), edges.select("a", "b"))
    return (stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct())
