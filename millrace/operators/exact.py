"""Sums of doubles without error: the exact sum, rounded once, whatever the order of rows and their partitions.

A finite double is a whole number of 53 bits times a power of two.  Powers are grouped in spans of 32; within a span a double is one whole number of at
most 87 bits, kept as an upper and a lower part, and such parts add up exactly as decimals.  So a key's sum is at most 67 pairs of whole
numbers, whose partial sums Spark adds before and after its shuffle; the pairs of a key become one double at the end.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SPAN, MARGIN, LOWER = 32, 54, 43


def _rounded(bins: list | None) -> float | None:
    """The double nearest to the sum of (upper * 2^LOWER + lower) * 2^(SPAN * span - MARGIN)."""
    if bins is None:
        return None
    least = min(b["span"] for b in bins)
    total = sum(((int(b["upper"]) << LOWER) + int(b["lower"])) << SPAN * (b["span"] - least) for b in bins)
    power = SPAN * least - MARGIN
    return total / (1 << -power) if power < 0 else float(total << power)  # division of whole numbers rounds once


@F.pandas_udf(DoubleType())
def _nearest(bins: pd.Series) -> pd.Series:
    return bins.map(_rounded)


def exact_sums(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """by, and for each name the sum of its values: the exact one, as `math.fsum` has it.

    Nulls don't count, and a key whose values are all null has null; a value that isn't finite fails the query, and so does a sum beyond the doubles.
    """
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a value to be summed is not finite"))).otherwise(x)
    each = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(k).alias("_name"), finite(v.cast("double")).alias("_x")) for k, v in values.items()))))
    span = F.coalesce(F.floor(F.log2(F.abs("_x")) / SPAN), F.lit(0)).cast("int")
    power = F.lit(MARGIN) - F.col("_span") * SPAN
    half = F.floor(power / 2)
    whole = F.col("_x") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)  # exact: powers of two
    upper = F.floor(F.col("_whole") / float(1 << LOWER))
    parts = each.withColumn("_span", span).withColumn("_whole", whole).withColumn("_upper", upper)
    lower = (F.col("_whole") - F.col("_upper") * float(1 << LOWER)).cast("long")
    add = lambda c: F.sum(c.cast("decimal(20,0)"))
    bins = parts.groupBy(*by, "_name", "_span").agg(add(F.col("_upper")).alias("upper"), add(lower).alias("lower"))
    pair = F.when(F.col("upper").isNotNull(), F.struct(F.col("_span").alias("span"), "upper", "lower"))
    sums = bins.groupBy(*by, "_name").agg(F.collect_list(pair).alias("bins")).withColumn("_sum", _nearest(F.when(F.size("bins") > 0, F.col("bins"))))
    return sums.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == k, F.col("_sum"))).alias(k) for k in values))


@F.pandas_udf(DoubleType())
def _fsum(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda a: None if a is None else math.fsum(a))


def array_sum(values: Column) -> Column:
    """The exact sum of an array of finite doubles, rounded once; null for null."""
    return _fsum(values)
