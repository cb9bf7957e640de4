"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on this machine, as in tests, a folder of the session's own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_millrace_shared", None)
        if at is None:
            at = spark._millrace_shared = tempfile.mkdtemp(prefix="millrace-")
    return at


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """`df`, written to the shared folder and read again: what follows starts from files that
    no lost executor takes along.  The table goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table from `written` once nothing reads it any more."""
    for path in df.inputFiles()[:1]:
        head, _, tail = path.partition("/millrace/")
        if tail:
            _remove(df.sparkSession, f"{head}/millrace/{tail.split('/')[0]}")
