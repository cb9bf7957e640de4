"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b); nodes have equal labels if and only if edges connect them.

    Each round every node moves to its smallest neighbour, if that is smaller, and the edges
    are drawn between what is left, so at least half the nodes of a component that still has
    edges vanish.  Moves and edges of a round are written, so that lineage doesn't grow.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        to = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).where("a <> p"), "moves")
        labels = labels.join(to, labels["label"] == to["a"], "left").select("node", F.coalesce("p", "label").alias("label"))
        pa, pb = to.toDF("x", "px"), to.toDF("y", "py")
        moved = edges.join(pa, edges["a"] == pa["x"], "left").join(pb, edges["b"] == pb["y"], "left").select(F.coalesce("px", "a").alias("a"), F.coalesce("py", "b").alias("b"))
        edges = written(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return written(labels, "labels")
