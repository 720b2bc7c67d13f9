"""Graphs: depth of nodes from start nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.staging import stage


def bfs_depth(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): the least number of edges from a start node, to ``max_depth``.

    Each level is one join and one anti join; lineage is cut per level. Cycles,
    repeated edges and nulls are harmless.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = stage(start.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "bfs")
    front = seen
    for level in range(1, max_depth + 1):
        new = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = stage(new.withColumn("depth", F.lit(level)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
