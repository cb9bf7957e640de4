"""Joins that hold when one key has a third of all rows, and broadcasts that are checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be sent to all executors.
MOST_ROWS = 100_000
#: A key with more than this share of the rows is joined by sending its fact along.
HOT_SHARE = 64


def sent(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """`df` for a join, to be broadcast if it has at most `most` rows; else Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_by_counts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A left join of `rows` with `facts`, which has each key once.

    Keys of rows are counted.  Fewer than HOT_SHARE of them have more than its share of all rows; their facts are broadcast, and the rest
    meet by a shuffle in which no key is larger."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = [r[key] for r in counts.where(F.col("_n") > max(1, total // HOT_SHARE)).select(key).collect()]  # fewer than HOT_SHARE
    is_hot = F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(False))
    own = facts.withColumnRenamed(key, "_key")
    meet = lambda left, right: left.join(right, left[key] == F.col("_key"), "left").drop("_key")
    some, none = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    missing = none.select(*rows.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != key))
    cold = meet(some.where(~is_hot), own)
    return (meet(some.where(is_hot), F.broadcast(own.where(F.col("_key").isin(hot)))).unionByName(cold) if hot else cold).unionByName(missing)
