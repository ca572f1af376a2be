"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramloom.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is its smallest node.

    Each round hooks every node to the smallest of its neighbours and itself,
    follows the hooks to their roots by pointer jumping, and keeps the edges
    between different roots. Roots at least halve where edges remain, so the
    rounds are logarithmic. A round shuffles edges once after a map-side
    minimum, so a node with any number of neighbours is one row per task; its
    tables are written, so lineage stays short. Nothing comes to the driver
    but counts.
    """
    spark = scratch.spark
    edges = scratch.save(edges.filter("a <> b").select("a", "b").distinct(), f"{label}-edges0")
    found, step, nodes = None, 0, None
    while left_over := edges.count():
        most = 2 * left_over  # nodes of these edges
        nodes = nodes or most
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root"))
        hooks = scratch.save(hooks, f"{label}-hooks{step}-0", most)
        jump = 0
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            further = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("next"), "root")
            jump += 1
            moved = scratch.save(further, f"{label}-hooks{step}-{jump}", most)
            still = moved.filter("next <> root").isEmpty()
            hooks = moved.select("node", F.col("next").alias("root"))
            if still:
                break
        if found is None:
            found = hooks
        else:
            found = found.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select(
                "node", F.coalesce("above", "root").alias("root")
            )
            found = scratch.save(found, f"{label}-found{step}", nodes)
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        step += 1
        edges = scratch.save(edges.distinct(), f"{label}-edges{step}", left_over)
    if found is None:
        return spark.createDataFrame([], "node long, component long")
    return found.select("node", F.col("root").alias("component"))
