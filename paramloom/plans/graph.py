"""Validation of step graphs: missing steps, cycles, levels, forced depth.

The driver's functions work on the few steps of a study; the DataFrame ones
on stored edge tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing(children: dict[str, list[str]]) -> dict[str, list[str]]:
    """For each step, the steps it needs that don't exist."""
    gaps = {name: [c for c in dict.fromkeys(needs) if c not in children] for name, needs in children.items()}
    return {name: gap for name, gap in gaps.items() if gap}


def cycle(children: dict[str, list[str]], start: str) -> list[str]:
    """A way from start that comes back to a step on it, or nothing."""
    done: set[str] = set()
    way: list[str] = [start]
    todo = [iter(children.get(start, ()))]
    while todo:
        for child in todo[-1]:
            if child in way:
                return [*way[way.index(child) :], child]
            if child not in done:
                way.append(child)
                todo.append(iter(children.get(child, ())))
                break
        else:
            done.add(way.pop())
            todo.pop()
    return []


def order(children: dict[str, list[str]], start: str) -> list[str]:
    """The steps under start and itself, each after those it needs."""
    out: dict[str, None] = {}
    seen: set[str] = set()  # a cycle is entered once
    todo = [(start, False)]
    while todo:
        name, ready = todo.pop()
        if ready:
            out[name] = None
        elif name not in seen:
            seen.add(name)
            todo.append((name, True))
            todo.extend((c, False) for c in reversed(children.get(name, [])) if c not in seen)
    return list(out)


def missing_steps(edges: DataFrame, nodes: DataFrame, child: str, node: str) -> DataFrame:
    """Edges whose child is no node."""
    return edges.join(nodes.select(F.col(node).alias(child)), child, "left_anti")


#: Steps of a way through a graph; a longer way is an error, never left out.
LONGEST = 10_000


def cycles(spark: SparkSession, edges: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(node, length, path) for nodes on a cycle: the shortest way back. A way ends where it meets itself."""
    edges.createOrReplaceTempView("_graph_edges")
    ways = spark.sql(
        f"""
        WITH RECURSIVE ways(node, at, way) MAX RECURSION LEVEL {longest} AS (
          SELECT parent, child, array(parent, child) FROM _graph_edges
          UNION ALL
          SELECT w.node, e.child, array_append(w.way, e.child)
          FROM ways w JOIN _graph_edges e ON w.at = e.parent
          WHERE w.at <> w.node AND (e.child = w.node OR NOT array_contains(w.way, e.child)))
        SELECT node, size(way) - 1 AS length, array_join(way, '>') AS path FROM ways WHERE at = node
        """
    )
    return ways.groupBy("node").agg(F.min(F.struct("length", "path")).alias("m")).select("node", "m.length", "m.path")


def levels(spark: SparkSession, edges: DataFrame, root: int, longest: int = LONGEST) -> DataFrame:
    """(node, level): the shortest number of edges from root."""
    edges.createOrReplaceTempView("_graph_edges")
    ways = spark.sql(
        f"""
        WITH RECURSIVE down(node, way) MAX RECURSION LEVEL {longest} AS (
          SELECT cast({root} AS bigint), array(cast({root} AS bigint))
          UNION ALL
          SELECT cast(e.child AS bigint), array_append(d.way, cast(e.child AS bigint))
          FROM down d JOIN _graph_edges e ON d.node = e.parent WHERE NOT array_contains(d.way, cast(e.child AS bigint)))
        SELECT node, size(way) - 1 AS level FROM down
        """
    )
    return ways.groupBy("node").agg(F.min("level").alias("level"))


def forced(levelled: DataFrame, depth: int) -> DataFrame:
    """remaining: how many levels from here down are computed again whatever is stored."""
    return levelled.withColumn("remaining", F.greatest(F.lit(depth) - F.col("level"), F.lit(0))).withColumn("forced", F.col("remaining") > 0)
