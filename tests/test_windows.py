"""Admission by rows, and digests in blocks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.sources import sinks
from millrace.streaming import windows


def test_windows_of_rows(spark, tmp_path):
    """10 rows in batches of 2, two at a time: 4, 4 and 2; in the caller's order, each once, over a restart."""
    rows = spark.createDataFrame([(i, f"r{i}", (i * 7) % 10) for i in range(10)], "id long, name string, rank int").repartition(3)
    n = windows.write_windows(rows.withColumnRenamed("rank", "at"), ["at"], str(tmp_path / "in"), batch=11)
    assert n == 1
    with pytest.raises(Exception, match="(?i)exist"):
        windows.write_windows(rows, ["rank"], str(tmp_path / "in"), batch=2)
    size = windows.window_size
    assert [size(b) for b in (1, 2, 10, 11, 12, 33, 64)] == [6, 12, 60, 55, 60, 33, 64] and size(2, 2) == 4
    for bad in ((0,), (65,), (1, 0)):
        with pytest.raises(ValueError, match="batches have"):
            size(*bad)


@pytest.mark.parametrize("partitions", [1, 5])
def test_a_window_a_batch(spark, tmp_path, partitions):
    rows = spark.createDataFrame([(i, (i * 7) % 31) for i in range(31)], "id long, at int").repartition(4)
    n = windows.write_windows(rows, ["at"], str(tmp_path / "in"), batch=2, partitions=partitions)
    assert n == 3
    got = []

    def run(most):
        stream = windows.admitted(spark, str(tmp_path / "in"), most, rows.schema)
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, k: got.append((k, [r["at"] for r in df.collect()]))).start()
        q.processAllAvailable()
        q.stop()

    run(1)
    assert got == [(0, list(range(12)))]
    run(3)
    run(3)  # nothing is left
    assert got == [(0, list(range(12))), (1, list(range(12, 24))), (2, list(range(24, 31)))]


def test_no_rows_no_windows(spark, tmp_path):
    assert windows.write_windows(spark.range(0), ["id"], str(tmp_path / "in"), batch=2) == 0


@pytest.mark.parametrize("most", [0, 10, 1 << 30])
def test_digests_of_any_size(spark, tmp_path, most):
    files = {"a": b"", "b": b"0123456789", "c": b"x" * 3_000_000}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in sinks.digests(spark, str(tmp_path), most).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    expected = sinks.digests(spark, str(tmp_path)).withColumn("sha256", F.when(F.col("bytes") == 10, "0").otherwise(F.col("sha256")))
    assert [r["problem"] for r in sinks.changed_files(spark, str(tmp_path), expected).collect()] == ["changed"]
