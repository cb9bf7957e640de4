"""Filter interaction audit by Walsh-Hadamard sums.

With n filters a row fails some of them, which is a mask of n bits.  How many rows of a part have
which mask decides everything about every order of the filters.

1. `failures`: one pass over the rows gives each its mask; the texts stay behind.
2. Copies: a row fails the copy filter if a smaller id has its text.  All copies of a text agree in
   the other filters, so rows are counted by text, part and label before they meet: a text that a
   third of all rows have is a few rows there.
3. `parity_sums`: for each part and label 2^n signed sums, of +1 for a row whose mask has an even number of
   bits in common with w and of -1 for one with an odd number.  They add up over partitions.
4. `cells`: the transform is its own inverse but for a factor of 2^n, so the counts of the masks come back exactly.
5. `orders`: for every order, what a filter removes after those before it is a sum of cells.  A filter's
   Shapley sum needs no orders: of the n! orders, n! / k put a given one of a row's k failed filters first.

Defined results: a null text is the empty one; a null part is the empty string; rows with equal ids are counted each
and no copies of one another; a row without an id is no copy and has none; of several labels of an
id any 1 counts; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.native import SPACES, let, words

LABELS = ("good", "toxic")


def contract_mask(text: Column) -> Column:
    """Bits of what a text fails: 1 few words, 2 few different words, 4 many capitals, 8 symbols."""
    of_words = let(
        words(text, SPACES),
        lambda ws: F.when(F.size(ws) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(ws)) < 50 * F.size(ws), 2).otherwise(0),
    )
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), 4).otherwise(0)
    return of_words + capitals + F.when(F.regexp_like(text, F.lit("[#$%&*|]")), 8).otherwise(0)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part, content (a hash of the text) and mask, with bit 4 left to copies."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("content"), contract_mask(t).alias("mask")
    )


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", conditions: Mapping[str, str] | None = None) -> DataFrame:
    """`rows` with a boolean for each label, false where there is none.  conditions: label to SQL over `labels`."""
    conditions = conditions or {"good": "quality = 1", "toxic": "toxic = 1"}
    own = labels.groupBy(F.col(doc_id).alias("label_id")).agg(*(F.max(F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in conditions.items()))
    return rows.join(own, F.col("id") == F.col("label_id"), "left").select(*rows.columns, *(F.coalesce(k, F.lit(False)).alias(k) for k in conditions))


def with_copies(rows: DataFrame, bit: int, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """part, labels, mask and n (rows), now with `bit` set for rows whose text has a smaller id somewhere in the table."""
    keys = ["content", "part", *labels, "mask"]
    by_id = rows.groupBy("id", *keys).agg(F.count("*").alias("n"))
    without = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without")
    alike = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), without)
    # as many rows a text as it has parts and labels
    least = F.min("first").over(Window.partitionBy("content"))
    passes = F.col("without") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    two = F.array(F.struct("mask", F.col("passes").alias("n")), F.struct((F.col("mask") + F.lit(1 << bit)).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    return alike.select("part", *labels, "mask", "n", passes.alias("passes")).select("part", *labels, F.inline(two)).where("n > 0")


def _sign(x: Column) -> Column:
    return 1 - 2 * F.bit_count(x).bitwiseAND(F.lit(1))


def parity_sums(rows: DataFrame, n_filters: int, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """part, labels and sums: element w + 1 is the sum over rows of (-1) to the number of bits that mask and w share."""
    signed = [F.sum(F.col("n") * _sign(F.col("mask").bitwiseAND(F.lit(w)))).alias(f"s{w}") for w in range(1 << n_filters)]
    return rows.groupBy("part", *labels).agg(*signed).select("part", *labels, F.array(*(f"s{w}" for w in range(1 << n_filters))).alias("sums"))


def cells(sums: DataFrame, n_filters: int, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row a part: `all` and an array for each label, element m + 1 of which counts the rows with mask m."""
    size = 1 << n_filters
    total = lambda w, on: F.sum(F.when(on, F.get("sums", F.lit(w))).otherwise(0))
    columns = {"all": F.lit(True)} | {k: F.col(k) for k in labels}
    per_part = sums.groupBy("part").agg(*(F.array(*(total(w, on) for w in range(size))).alias(k) for k, on in columns.items()))
    at = F.sequence(F.lit(0), F.lit(size - 1))

    def inverse(s: Column) -> Column:
        back = lambda m: F.aggregate(at, F.lit(0).cast("long"), lambda acc, w: acc + F.get(s, w) * _sign(m.bitwiseAND(w)))
        return F.transform(at, lambda m: F.shiftright(back(m), n_filters))  # divides exactly

    return per_part.select("part", *(inverse(F.col(k)).alias(k) for k in columns))


def orders(cells_: DataFrame, filters: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """part, filter_order, step and its counts, for each of the n! orders: kept, removed, redundant, unique_fails, `label`_lost and shapley."""
    n = len(filters)
    steps = [
        F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(sum(1 << filters.index(x) for x in o[:k])).alias("before"), F.lit(1 << filters.index(o[k])).alias("own"))
        for o in itertools.permutations(filters)
        for k in range(n)
    ]
    at = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    zero = F.lit(0).cast("long")

    def count(of: str, where) -> Column:
        return F.aggregate(at, zero, lambda acc, m: acc + F.when(where(m), F.get(F.col(of), m)).otherwise(zero))

    before, own = F.col("before"), F.col("own")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: fails(m) & ~gone(m)
    share = lambda acc, m: acc + F.when(fails(m), F.get(F.col("all"), m) * F.get(weights, m)).otherwise(zero)
    weights = F.array(*(F.lit(math.factorial(n) // max(1, m.bit_count())).cast("long") for m in range(1 << n)))
    return cells_.select("*", F.inline(F.array(*steps))).select(
        "part", "filter_order", "step", count("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"), count("all", removed).alias("removed"),
        count("all", lambda m: fails(m) & gone(m)).alias("redundant"), F.get("all", own).alias("unique_fails"),
        *(count(k, removed).alias(f"{k}_lost") for k in labels), F.aggregate(at, zero, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """`orders` of the five filters A to E over the documents of each part."""
    rows = with_copies(labelled(failures(docs, doc_id, text, part), labels, doc_id), bit=4)
    return orders(cells(parity_sums(rows, 5), 5), "ABCDE")
