"""Connected components of an edge list, as DataFrame rounds with tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with its component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges
    are stars. Each step is one grouping of at most as many rows as there are edges;
    a node's neighbours are never gathered, only their minimum is, and the minimum
    is brought back by a join that adaptive execution can split.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-small")
        # stars: no node is both a member and a root, and each member has one root
        roots = new.select(F.col("v").alias("u")).distinct()
        done = new.join(roots, "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty()
        now = new
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
