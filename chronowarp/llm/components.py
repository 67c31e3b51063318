"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join whose two sides are shuffled afresh, so the planner can split a hub's rows;
each round is written out.  Rounds end once the edges are stars around their smallest ids; the driver learns only
whether they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one and then none from a larger one."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id on an edge the smallest id that can be reached. Loops and repeats may occur."""
    x, y = F.col(a), F.col(b)
    known = edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    n = known.count()
    nodes = known.select("u").union(known.select("v")).distinct().withColumnRenamed("u", "id")
    nodes = scratch.materialise(nodes, "cc-nodes", n)
    known = scratch.materialise(known.where("u <> v").distinct(), "cc-edges", n)
    while not _stars(known):
        both = known.union(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-min", n)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.materialise(large, "cc-large", n)
        least = scratch.materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min", n)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        known = scratch.materialise(small.distinct(), "cc-small", n)
    return nodes.join(known.select(F.col("u").alias("id"), F.col("v").alias("__c")), "id", "left").select("id", F.coalesce("__c", "id").alias("component"))
