"""Connected components of an edge table, by grouped minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is its smallest node.

    Each round gives a node the smallest label among its neighbours and itself, then the label of
    that label, until nothing changes; the number of rounds grows with the logarithm of the longest
    chain. Each round is written to the shared folder, so lineage stays short.
    """
    both = saved(edges.select("a", "b").unionAll(edges.selectExpr("b as a", "a as b")).where("a != b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        nearer = saved(moved.join(jump, "to", "left").select("node", F.least("to", F.coalesce("jump", "to")).alias("component"), F.col("component").alias("was")), "labels")
        discard(before)
        before, labels = nearer, nearer.select("node", "component")
        if nearer.where("component != was").isEmpty():
            discard(both)
            return labels
