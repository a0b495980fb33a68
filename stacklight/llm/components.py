"""Connected components of an edge table by alternating large and small stars.

Nothing of the graph comes to the driver but two numbers a round. A vertex with many neighbours is one row of a minimum by
key (combined before the shuffle) and a skewed key of a join, which adaptive execution splits. Rounds grow with the logarithm
of the longest path; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long), nulls and loops ignored -> (id, component), for each vertex of an edge the smallest id it
    reaches. An empty edge table gives an empty result."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a goes to the least of a's neighbours and a itself
        both = now.union(now.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components")  # apart from the join, whose skewed keys can then be split
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components")
        # small star: a and its smaller neighbours go to the least of them
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "components")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct(), "components")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
        mark = (seen["n"], seen["h"])
    raise RuntimeError("the components did not settle")
