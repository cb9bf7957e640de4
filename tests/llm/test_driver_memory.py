"""What the driver holds while it learns from the sketch, the filter and the sample: little besides their fixed sizes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ngram_join, quality_classifier


@pytest.fixture
def traced():
    tracemalloc.start()
    yield lambda: tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()


def test_levels(traced):
    counts = np.random.default_rng(1).poisson(3, 1 << ngram_join.BITS).astype(np.uint32)
    tracemalloc.reset_peak()
    before = traced()
    assert ngram_join.levels(counts).max() <= 63 and traced() - before < 16


def test_filter_bits(spark, traced):
    n = 200_000
    bits = ngram_join._bits(spark.range(n).select(F.xxhash64("id").alias("key")))
    assert traced() < 16  # 131,072 words
    key = np.array(spark.range(0, n, 500).select(F.xxhash64("id")).toArrow().column(0)).view(np.uint64)
    assert (bits.view(np.uint64)[(key >> np.uint64(6) & np.uint64(ngram_join.FILTER_WORDS - 1)).astype(np.int64)] >> (key & np.uint64(63)) & np.uint64(1)).all()
    assert ngram_join._bits(spark.range(0).select(F.col("id").alias("key"))).sum() == 0


def test_training_rows_are_arrow_memory():
    values = np.arange(5, dtype=np.int32)
    before = pa.total_allocated_bytes()
    held = quality_classifier.held(values)
    assert held.tolist() == values.tolist() and pa.total_allocated_bytes() > before and quality_classifier.held(values[:0]).size == 0
