"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakaudit.llm.common import materialise


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node.
    With ``known``, the components so far, the edges are added to them: only those between different
    components are worked on.

    Each round hooks every root to its smallest neighbour, flattens the trees by pointer
    jumping and contracts the edges to what still joins different roots. Every step is a
    table in the shared folder; a hub costs one row per edge and is summed on the map side.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    open_edges = edges.where("a <> b").select("a", "b")
    if known is None:
        labels = materialise(nodes, "labels")
    else:
        labels = known.select("node", F.col("component").alias("root"))
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            own = labels.select(F.col("node").alias("of"), "root")
            open_edges = open_edges.join(own, F.col(end) == F.col("of"), "left").select(F.coalesce("root", end).alias(end), other)
        open_edges = materialise(open_edges.where("a <> b").distinct(), "edges")
        if open_edges.isEmpty():
            return known
        labels = materialise(labels.unionByName(nodes.join(labels.select("node"), "node", "left_anti")), "labels")
    while not open_edges.isEmpty():
        both = open_edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        hooks = both.groupBy(F.col("e.a").alias("child")).agg(F.min("e.b").alias("parent")).where("parent < child")
        hooks = materialise(hooks, "hooks")
        while True:
            up = hooks.select(F.col("child").alias("via"), F.col("parent").alias("top"))
            jumped = hooks.join(up, F.col("parent") == F.col("via"), "left").select("child", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved"))
            jumped = materialise(jumped, "hooks")
            hooks = jumped.select("child", "parent")
            if jumped.where("moved").isEmpty():
                break
        labels = materialise(labels.join(hooks, F.col("root") == F.col("child"), "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            moved = hooks.select("child", "parent")
            open_edges = open_edges.join(moved, F.col(end) == F.col("child"), "left").select(F.coalesce("parent", end).alias(end), other)
        open_edges = materialise(open_edges.where("a <> b").distinct(), "edges")
    return labels.select("node", F.col("root").alias("component"))
