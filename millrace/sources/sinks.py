"""Sinks.  Spark's commit protocol makes directories appear whole; existing outputs are never overwritten."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.growing import BLOCK, _open

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Larger files are hashed block by block.
WHOLE_BYTES = 64 << 20


def by_split(rows: DataFrame, path: str, *by: str, format_: str = "parquet") -> None:
    """One folder for each split (or shard), which readers can prune to; an existing path is an error."""
    rows.write.mode("errorifexists").partitionBy(*by).format(format_).save(path)


def append(rows: DataFrame, path: str) -> None:
    """Appends to a JSON log; numbers that JSON doesn't have are refused."""
    doubles = [c for c, t in rows.dtypes if t in ("double", "float")]
    for c in doubles:
        rows = rows.withColumn(c, F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)))
    rows.write.mode("append").json(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def example_files(rows: DataFrame, path: str, by: str = "source") -> None:
    """Writes examples (of `review.examples`, a few a source) as `samples.md` and `samples.jsonl` folders of one file each."""
    rows.coalesce(1).sortWithinPartitions(by, "rn").select("markdown").write.mode("errorifexists").text(f"{path}/samples.md")
    rows.coalesce(1).sortWithinPartitions(by, "rn").drop("markdown", "rn").write.mode("errorifexists").json(f"{path}/samples.jsonl")


def require_identity(spark: SparkSession, path: str, identity: dict) -> bool:
    """Binds a folder of cached results to what they were made from.  The first call writes the identity and returns False; later
    calls return True, or raise where theirs is another."""
    text = json.dumps(identity, ensure_ascii=False, sort_keys=True)
    row = spark.createDataFrame([(text,)], "value string")
    try:
        row.coalesce(1).write.mode("errorifexists").text(f"{path}/identity")
        return False
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    if [r["value"] for r in spark.read.text(f"{path}/identity").limit(2).collect()] != [text]:
        raise ValueError(f"{path} holds results of other sources or models")
    return True


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            digest = hashlib.sha256()
            system, at = _open(name)
            with system.open_input_stream(at) as file:
                while block := file.read(BLOCK):
                    digest.update(block)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([digest.hexdigest()])], ["path", "bytes", "sha256"])


def digests(spark: SparkSession, path: str, most_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, bytes and sha256 of each file below, but for those whose name begins with a dot or an underscore.  Files up to `most_bytes` are one
    value each; larger ones are read block by block in the tasks, in constant memory.  Paths are those that pyarrow.fs opens."""
    system, top = _open(path)
    found = system.get_file_info(fs.FileSelector(top, recursive=True)) if system.get_file_info(top).type == fs.FileType.Directory else [system.get_file_info(top)]
    hidden = lambda name: any(x.startswith((".", "_")) for x in name.removeprefix(top).split("/"))
    # Spark leaves out files without a byte.
    empty = [(f"{path.rstrip('/')}{f.path.removeprefix(top)}", 0, hashlib.sha256().hexdigest()) for f in found if f.type == fs.FileType.File and not f.size and not hidden(f.path)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("bytes"))
    none = spark.createDataFrame(empty, "path string, bytes long, sha256 string")
    return small.unionByName(large.mapInArrow(_hash_blocks, "path string, bytes long, sha256 string")).unionByName(none)


def manifest(spark: SparkSession, path: str, facts: dict, counts: dict[str, DataFrame], files: DataFrame | None = None) -> dict:
    """Facts, counters (small aggregates) and file digests as one JSON text file, which is also returned."""
    whole = facts | {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in counts.items()}
    if files is not None:
        whole["files"] = [r.asDict() for r in files.orderBy("path").collect()]
    spark.createDataFrame([(json.dumps(whole, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return whole


def changed_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or differ from the expected digests (path, sha256)."""
    now = digests(spark, path).select("path", F.col("sha256").alias("_now"))
    both = now.join(expected.select("path", "sha256"), "path", "full_outer")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("_now") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")
