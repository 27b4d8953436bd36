"""Connected components by hooking and shortcuts: parents move to smaller nodes until all are roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a``, ``b``, both long); the component is its smallest node.

    Each edge points from the larger to the smaller node.  In a step a node
    keeps its smallest parent, its other parents hang on that one, and all of
    them point on to the parent of the parent; the number of steps grows with the
    logarithm of a component's depth.  A step shuffles the edges twice: by node,
    and by parent in a join that splits a hub's rows.  Two steps are written to
    the shared folder together.  Loops and repeated edges do no harm.
    """
    def step(pairs: DataFrame) -> DataFrame:
        by_node = pairs.select("a", "b").repartition("a").distinct()
        least = by_node.groupBy("a").agg(F.min("b").alias("m"))
        above = least.select(F.col("a").alias("m"), F.col("m").alias("above"))
        rows = by_node.join(least, "a").join(above, "m", "left")
        keeps = F.col("b") == F.col("m")
        return rows.select(F.when(keeps, F.col("a")).otherwise(F.col("b")).alias("a"), F.coalesce("above", "m").alias("b"),
                           (~keeps | F.col("above").isNotNull()).alias("moved"))

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    moved = True
    while moved:
        now = cut_lineage(step(step(now)))
        moved = not now.where("moved").isEmpty()
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select("component").distinct().select(F.col("component").alias("node"), "component"))
