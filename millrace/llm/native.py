"""Column expressions that the native operators share (no Python on executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space, or runs of digits, letters a-z and anything beyond ASCII, after
#: lower-casing A-Z; these are what stands between words.
SPACES, PLAIN_GAPS = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row.

    A column that a lambda refers to may be inlined by the optimizer and then be
    computed once for each element; a lambda's own variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, gaps: str) -> Column:
    """What stands between the gaps, in order; a null text has no words.  (Splitting takes a quarter of the time of extracting matches.)"""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def covered(starts: Column, width: int | Callable[[Column], tuple[Column, Column]]) -> Column:
    """How many places the intervals cover that begin at the sorted `starts`.

    width: that of all intervals, or a function that gives begin and end of an element.
    """
    ends = width if callable(width) else lambda p: (p, p + F.lit(width))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, p: Column) -> Column:
        begin, end = (x.cast("long") for x in ends(p))
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(begin, acc["end"]))).alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(starts, zero, step)["n"]


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that none of the columns has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
