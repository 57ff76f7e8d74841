"""Connected components of an edge table, as joins and aggregates on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, doubles these pointers until they name
    roots, and contracts the edges to the roots. Self loops and repeated edges are allowed; rows
    with a null end are ignored; no edges give no rows. Only edges between different roots go on to
    the next round, and all joins have a side with unique keys, so hub nodes are split by AQE.
    """
    work = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna()
    work = cut(work.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = work.select(F.col("a").alias("node")).union(work.select(F.col("b"))).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("component")), "labels")
    work = work.filter("a < b")
    while not work.isEmpty():
        # edges hold a < b, so the smallest neighbour below a node is the least a of its rows
        up = cut(work.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            step = cut(up.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "up")
            up = step.select("node", "up")
            if step.filter("moved").isEmpty():
                break
        as_a = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        as_b = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        moved = cut(work.join(as_a, "a", "left").select(F.coalesce("ra", "a").alias("a"), "b"), "edges")
        moved = moved.join(as_b, "b", "left").select("a", F.coalesce("rb", "b").alias("b")).filter("a <> b")
        work = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        to = up.select(F.col("node").alias("component"), F.col("up").alias("root"))
        labels = cut(labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    return labels
