"""Connected components of a link table, for any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of every node that has a link.

    Large stars and small stars in turn: a node's larger neighbours, then it and its smaller
    ones, are linked to the least of them all. Roots are hooked as well as leaves, so chains in
    any order shrink by a factor a round; it ends when every component is one star, however
    many rounds that takes. Minima and joins only; each half round's links are a written
    table, so nothing is recomputed and lost executors cost one half round at most. Hot nodes
    are pre-aggregated by the partial minimum, and their join partitions can be split.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a) != F.col(b))
    edges = written(ends.distinct(), "component-links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # The larger neighbour of each link takes the smaller one's least neighbour.
        large = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        large = written(large.distinct(), "component-links")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lower.withColumnRenamed("m", "v")).distinct(), "component-links")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    # Written, so that the planner knows their size and may broadcast them.
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres), "component-labels")


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one lower end, and no lower end is an upper one."""
    if edges.groupBy("u").count().filter("count > 1").limit(1).count():
        return False
    return not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
