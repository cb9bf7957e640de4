"""Admission by rows: a stream that takes windows of rows in the caller's order, exactly one a batch, or up to `at_once` of them.

Rows are numbered by ranges and written with their window; the source's offset is the number of windows admitted.  A window has at most
`most_rows` rows and is one task's, so no more windows are in work at once than there are cores, whatever `at_once` is; that is for streams of so many windows
that a batch for each takes too long.  A column `window` of the schema gives a row's window.  A batch that is run again reads the same windows, and a restart goes on with the next one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace.operators.ordered import numbered
from millrace.sources.growing import _open

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

PLACE, WINDOW = "_place", "window"


def window_size(batch: int, batches: int = 6, most_rows: int = 64) -> int:
    """Rows that are admitted at once: `batches` batches, or as many whole ones as most_rows allows."""
    if not 1 <= batch <= most_rows or batches < 1:
        raise ValueError(f"batches have 1 to {most_rows} rows, and a window has one batch at least")
    return batch * min(batches, most_rows // batch)


def write_windows(rows: DataFrame, order: list[str], path: str, batch: int, partitions: int | None = None) -> int:
    """Writes rows in windows, in the order, below a path that must not exist; returns how many windows there are."""
    size = window_size(batch)
    placed = numbered(rows, order, name=PLACE, partitions=partitions).withColumn("window", F.floor((F.col(PLACE) - 1) / size))
    # A window goes to one task, and so to one file.
    placed.repartition("window").sortWithinPartitions("window", PLACE).write.mode("errorifexists").partitionBy("window").parquet(path)
    return rows.sparkSession.read.parquet(path).agg(F.coalesce(F.max("window") + 1, F.lit(0)).alias("n")).first()["n"] if rows.limit(1).count() else 0


@dataclass
class Window(InputPartition):
    number: int


class AdmittedStream(DataSourceStreamReader):
    def __init__(self, path: str, windows: int, schema: StructType, at_once: int = 1):
        self._path, self._windows, self._columns, self._at, self._at_once = path, windows, schema.names, 0, at_once

    def initialOffset(self) -> dict:  # noqa: N802
        return {"windows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """`at_once` windows more than the last planned batch has, if there are as many; Spark asks once a batch."""
        return {"windows": min(self._at + self._at_once, self._windows)}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        self._at = end["windows"]  # also called after a restart, with the last offset as both
        return [Window(k) for k in range(start["windows"], end["windows"])]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        system, top = _open(self._path)
        files = [f.path for f in system.get_file_info(fs.FileSelector(f"{top}/window={partition.number}")) if f.base_name.endswith(".parquet")]
        table = pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read() for f in files]).sort_by(PLACE)
        if WINDOW in self._columns:  # the folder's name, and not in the file
            table = table.append_column(WINDOW, pa.array([partition.number] * table.num_rows, pa.int64()))
        yield from table.select(self._columns).to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class AdmittedWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_windows"

    def schema(self) -> StructType:
        raise ValueError("row_windows needs the schema of the rows")

    def streamReader(self, schema: StructType) -> AdmittedStream:  # noqa: N802
        return AdmittedStream(self.options["path"], int(self.options["windows"]), schema, int(self.options.get("atonce", self.options.get("atOnce", 1))))


def admitted(spark: SparkSession, path: str, windows: int, schema: StructType, at_once: int = 1) -> DataFrame:
    """A stream over `write_windows`' rows, up to `at_once` windows a batch."""
    if at_once < 1:
        raise ValueError("a batch has one window at least")
    spark.dataSource.register(AdmittedWindows)
    return spark.readStream.format("row_windows").schema(schema).option("windows", windows).option("atOnce", at_once).load(path)
