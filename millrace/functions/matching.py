"""Substrings: which texts contain any of many patterns, by Aho-Corasick automata."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def contains_any(text: Column, patterns: list[str]) -> Column:
    """Whether the text contains one of the patterns, wherever it begins: one pass over each text, however many patterns there are.

    A null text contains none, and no pattern is in no text.  The patterns travel with the tasks and take about 60 bytes a character
    in a worker, so callers bound them; each task builds its automaton once.
    """
    bounded_batches()

    @F.pandas_udf("boolean")
    def contains(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in patterns:
            automaton.add_word(p)
        automaton.make_automaton()
        found = lambda t: t is not None and next(automaton.iter(t), None) is not None
        for texts in batches:
            yield texts.map(found).astype(bool)

    return contains(text) if patterns else F.lit(False)
