"""Input of an encoder: vectors of token ids in order, padded batches, and attention pooling in mergeable parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.routing import pad_mask, right_pad
from millrace.operators.joins import join_by_counts
from millrace.operators.ordered import numbered

#: Summaries that are merged at once.
FAN_IN = 128


def looked_up(rows: DataFrame, vectors: DataFrame, key: str, ids: str, token: str, vector: str) -> DataFrame:
    """key, vectors (those of the ids, in their order) and problem: null, or `token_out_of_range` where an id has no vector; vectors is null then.

    key is unique; an id that a third of all places have is met by broadcast (`join_by_counts`).  No ids give no vectors; null ids are no ids."""
    places = rows.select(key, F.posexplode(ids).alias("_pos", token))
    found = join_by_counts(places, vectors.select(token, F.col(vector).alias("_vector")), token)
    whole = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_vector"))).alias("_all"), F.bool_or(F.col("_vector").isNull()).alias("_bad"))
    out = rows.select(key, F.col(ids).alias("_ids")).join(whole, key, "left")
    bad = F.coalesce("_bad", F.lit(False))
    some = F.transform("_all", lambda p: p["_vector"])
    none = F.filter(some, lambda v: F.lit(False))
    empty = F.when(F.coalesce(F.size("_ids"), F.lit(0)) <= 0, F.coalesce(none, F.array().cast(f"array<{dict(vectors.dtypes)[vector]}>")))
    return out.select(key, F.when(~bad, F.coalesce(some, empty)).alias("vectors"), F.when(bad, "token_out_of_range").alias("problem"))


def padded_batches(rows: DataFrame, key: str, ids: str, batch: int, pad: int = 0, partitions: int | None = None) -> DataFrame:
    """key, batch, padded and mask: rows in the order of `key`, `batch` at a time, each padded to the longest of its batch."""
    dealt = numbered(rows.select(key, ids), [key], name="_rn", partitions=partitions).withColumn("batch", F.floor((F.col("_rn") - 1) / batch))
    wide = dealt.withColumn("_width", F.max(F.size(ids)).over(Window.partitionBy("batch")))
    return wide.select(key, "batch", right_pad(F.col(ids), F.col("_width"), pad).alias("padded"), F.when(F.col("_width") > 0, pad_mask(F.col(ids), F.col("_width"))).otherwise(F.array().cast("array<boolean>")).alias("mask"))


def _scaled_sum(parts: Column, top: Column) -> tuple[Column, Column]:
    """Of parts (top, weight, total), brought to a common top: the sums of weights and of totals."""
    scale = lambda p: F.exp(p["top"] - top)
    weight = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["weight"] * scale(p))
    first = F.transform(F.get(parts, F.lit(0))["total"], lambda x: F.lit(0.0))
    total = F.aggregate(parts, first, lambda a, p: F.zip_with(a, p["total"], lambda x, y: x + y * scale(p)))
    return weight, total


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """One (top, weight, total) for the parts of each key."""
    own = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "top", "weight", "total"))).alias("_parts"))
    own = own.withColumn("_top", F.array_max(F.transform("_parts", lambda p: p["top"])))
    weight, total = _scaled_sum(F.col("_parts"), F.col("_top"))
    return own.select(*by, F.col("_top").alias("top"), weight.alias("weight"), total.alias("total"))


def softmax_parts(rows: DataFrame, by: list[str], part: Column, order: str, score: str, vector: str) -> DataFrame:
    """by, _part and what pooling needs of a part: top (its largest score), weight and total (sums of exp(score - top), and of that times the vector)."""
    one = rows.select(*by, part.alias("_own"), F.col(order).alias("_part"), F.col(score).cast("double").alias("top"), F.lit(1.0).alias("weight"), F.col(vector).cast("array<double>").alias("total"))
    return _merged(one, [*by, "_own"]).withColumnRenamed("_own", "_part")


def softmax_pool(rows: DataFrame, by: list[str], order: str, score: str, vector: str, cut: int = FAN_IN, fan_in: int = FAN_IN, levels: int = 2) -> DataFrame:
    """by and pooled: the vectors' mean, weighted by the softmax of their scores over all rows of the key.

    Rows are pooled by `cut` places (order: 0, 1, 2 ...), and parts are merged `fan_in` at a time, `levels` times, before the last merge; so
    the result is that of the whole softmax for any cut, and a key of any length is never one list of rows."""
    parts = softmax_parts(rows, by, F.floor(F.col(order) / cut), order, score, vector)
    for _ in range(levels):
        merged = _merged(parts.withColumn("_own", F.floor(F.col("_part") / fan_in)), [*by, "_own"])
        parts = merged.withColumnRenamed("_own", "_part")
    return _merged(parts, by).select(*by, F.transform("total", lambda x: x / F.col("weight")).alias("pooled"))
