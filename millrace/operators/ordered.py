"""Work in an order on keys of any size: numbers of rows, windows over rows before, and the latest of another table.

Rows are dealt to tasks by ranges of (key, order), so that a key with a third of all rows is many tasks.  What a range needs of those before
it is carried in: counts for numbers, a value for the latest.  That is a row a range, or a row a key and range.  Windows over the
w - 1 rows before a row are taken in blocks of numbered rows, each with a copy of the last w - 1 rows of the block before.

Ranges are drawn from a sample, so the table of rows with their ranges is written once; results don't depend on it.  The order must tell the rows
of a key apart where it matters which comes first; equal places share a range.  Nulls come first, and a null key is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.groups import cut

BLOCK = 10_000


def in_ranges(rows: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """`rows`, written, with _range: 0, 1, 2 ... so that a smaller range comes before a larger one."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Adds the number of each row, from 1, in the order, for each key."""
    by = by or []
    rows = in_ranges(rows, *by, *order, partitions=partitions).withColumn("_by", F.struct(*by, F.lit(0).alias("_all")))
    earlier = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range", "_by").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", "_by", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy("_range", "_by").orderBy(*order)))
    return own.join(before, ["_range", "_by"]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_by", "_before")


def over_rows_before(rows: DataFrame, order: list[str], by: list[str] | None, before: int, columns: dict[str, tuple[Column, int, int]], partitions: int | None = None, block: int = BLOCK) -> DataFrame:
    """Adds columns over frames of rows: name to (aggregate or lag-like function, first, last), with first >= -before and last <= 0."""
    by, block = by or [], max(block, before)
    numbers = numbered(rows, order, by, "_rn", partitions)
    place = F.col("_rn") - 1
    own = F.floor(place / block)
    there = F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own")))
    also = F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own")), F.struct((own + 1).alias("_block"), F.lit(False).alias("_own")))
    dealt = numbers.select("*", F.inline(F.when(place % block >= block - before, also).otherwise(there)))
    w = Window.partitionBy(*by, "_block").orderBy("_rn")
    out = dealt.withColumns({k: f.over(w.rowsBetween(first, last)) for k, (f, first, last) in columns.items()})
    return out.where("_own").drop("_rn", "_block", "_own")


def latest(rows: DataFrame, facts: DataFrame, at: str, value: str, key: str, partitions: int | None = None) -> DataFrame:
    """Adds `value` of the fact with the largest `at` that is not after the row's (of equal ones the largest value), null before the first.

    rows and facts meet in one table, ordered by `at`, facts before rows; `key` tells rows apart.  So neither side is sent to the other."""
    kind = lambda df, k, v: df.withColumns({"_kind": F.lit(k), "_value": v})
    first = kind(facts.where(F.col(at).isNotNull()).select(F.col(at), F.col(value)), 0, F.col(value)).drop(value)
    both = in_ranges(first.unionByName(kind(rows, 1, F.lit(None).cast(facts.schema[value].dataType)), allowMissingColumns=True), at, "_kind", "_value", key, partitions=partitions)
    w = Window.partitionBy("_range").orderBy(at, "_kind", "_value", key)
    own = both.withColumn(value, F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = both.where("_kind = 0").groupBy("_range").agg(F.max(F.struct(F.col(at).alias("at"), F.col("_value").alias("v"))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = both.select("_range").distinct().join(ends, "_range", "left").select("_range", carried["v"].alias("_carried"))  # a row a range
    joined = own.where("_kind = 1").join(F.broadcast(ranges), "_range")
    return joined.withColumn(value, F.coalesce(value, "_carried")).select(*rows.columns, value)
