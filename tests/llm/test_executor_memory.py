"""What the n-gram join's tasks hold and send at once: bounded by bytes, whatever the rows' lengths."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import ngram_join, spans


class Taken:
    """Stands for a DataFrame; gives what is to run in Python."""

    def mapInArrow(self, run, schema):
        return run


def test_sketch_counts_in_place():
    sketch, tokens = ngram_join.Sketch(), np.random.default_rng(2).integers(0, 1 << 64, 1 << 19, np.uint64)
    tracemalloc.start()
    for _ in range(9):
        sketch.add(tokens)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 24  # the tokens' buckets; before, 4 million waiting ones and as many counts
    expected = 9 * np.bincount((tokens >> np.uint64(64 - ngram_join.BITS)).astype(np.int64), minlength=1 << ngram_join.BITS)
    assert (sketch.counts == expected.astype(np.uint64)).all()


def test_pairs_leave_in_small_batches():
    key = np.repeat(np.arange(1, 2001, dtype=np.uint64), 10)
    node = np.arange(1, len(key) + 1)
    data = ngram_join._pack(key, node, np.full(len(key), 9), np.ones(len(key)))
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([False]), pa.array([data], pa.binary())], ["part", "is_long", "data"])
    found = list(ngram_join._lists(Taken(), 16)(iter([batch])))
    assert max(len(x) for x in found) <= 1 << 14
    pairs = {(x, y) for b in found for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)}
    assert pairs == {(10 * k + i, 10 * k + j) for k in range(2000) for i in range(1, 11) for j in range(i + 1, 11)} and sum(map(len, found)) == len(pairs)


def test_join_bounds_batches_by_bytes(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        ngram_join.join(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
        rows = spark.range(0, 200, numPartitions=1).select(F.repeat(F.lit("x"), 50_000).alias("t"))
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").toArrow()
        assert max(sizes.column("n").to_pylist()) < 1.2e6  # 10 MB in one before
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_tasks_leave_nothing_in_their_worker():
    spans.kept(("large",), lambda: np.zeros(10))
    assert list(spans.alone(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and not spans._KEPT
