"""Groups of records that must stay together: connected components labelled by their smallest name."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset and all runs on this machine, as in tests, a folder of the session's own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark._millrace_cut = getattr(spark, "_millrace_cut", None) or tempfile.mkdtemp(prefix="millrace-")
    return at


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/millrace-core/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node, as text, of the node's component.

    By contraction: each round moves every node to its smallest neighbour if that is smaller and redraws the
    edges between what is left, so a component's edges are gone after about as many rounds as its size has binary digits.
    Moves and edges of a round are written, and the labels once, at the end.
    """
    edges = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        to = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).where("a <> p"), "moves")
        labels = labels.join(to, labels["label"] == to["a"], "left").select("node", F.coalesce("p", "label").alias("label"))
        x, y = to.toDF("x", "px"), to.toDF("y", "py")
        moved = edges.join(x, edges["a"] == x["x"], "left").join(y, edges["b"] == y["y"], "left").select(F.coalesce("px", "a").alias("a"), F.coalesce("py", "b").alias("b"))
        edges = cut(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return cut(labels, "labels")


def record_edges(rows: DataFrame, group: str, extra: str, prompt_hash: str) -> DataFrame:
    """Edges of all accepted rows, those that are duplicates included: group with itself, with its extra group, and with the first group of an equal prompt."""
    own = rows.select(F.col(group).alias("a"), F.col(group).alias("b"))
    with_extra = rows.where(F.col(extra).isNotNull()).select(F.col(group).alias("a"), F.col(extra).alias("b"))
    least = rows.groupBy(prompt_hash).agg(F.min(group).alias("b"))
    same_prompt = rows.join(least, prompt_hash).select(F.col(group).alias("a"), "b")
    return own.unionByName(with_extra).unionByName(same_prompt).distinct()
