"""Files of lines that grow while they are read, as a source for streams and tables.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").load(folder)

A stream's offset is a byte position for each file, always just behind a line end.  A batch goes from the positions of
the batch before to the last line end that is there now; what follows it waits, be it half a line or half a character.  The bytes
between are dealt to tasks in ranges of `rangeBytes`; a task takes the lines that begin in its range.  Both ends are fixed before a task
runs, so a line that is appended meanwhile comes in the next batch, once, and a task that is run again reads the same bytes.

As a table it holds the whole lines that are there when it is read.

Defined results: a file without a line end has no lines yet; empty lines are lines; a new file begins at its start; a file that
is shorter than what was read of it, and a whole line that isn't UTF-8, are errors.  Files whose names begin with a dot or an underscore are
left out.  Paths are those that pyarrow.fs opens (shared mounts, s3, gs, hdfs); the driver reads of each file its unfinished line only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SCHEMA = "path string, begin bigint, value string"
RANGE_BYTES, BLOCK = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [begin, end); `first` if one is known to begin at `begin`.  No line goes beyond `last`."""

    path: str
    begin: int
    end: int
    last: int
    first: bool


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(path: str) -> dict[str, int]:
    """Sizes of the files of a folder, or of one file, by name."""
    system, top = _open(path)
    info = system.get_file_info(top)
    if info.type == fs.FileType.File:
        return {top: info.size}
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _last_line_end(file, begin: int, size: int) -> int:
    """The place behind the last line end in [begin, size), or begin."""
    end = size
    while end > begin:
        start = max(begin, end - BLOCK)
        at = file.read_at(end - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return begin


def _lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines of a range."""
    system, _ = _open(path)
    with system.open_input_file(part.path) as file:
        at = part.begin if part.first else part.begin - 1  # a line begins at `begin` only if a line end stands before
        skip, held = not part.first, b""
        while at < part.last:
            block = file.read_at(min(BLOCK, part.last - at), at)
            if not block:
                raise ValueError(f"{part.path} became shorter")
            begin, text = at - len(held), held + block
            at += len(block)
            *whole, held = text.split(b"\n")
            for line in whole:
                if not skip:
                    if begin >= part.end:
                        return
                    yield begin, line
                skip = False
                begin += len(line) + 1
            if not skip and begin >= part.end:
                return


def _batches(path: str, part: Range, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []

    def batch() -> pa.RecordBatch:
        values = pa.array([v for _, v in held], pa.binary()).cast(pa.string())  # checks UTF-8
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(held)), pa.array([b for b, _ in held], pa.int64()), values], ["path", "begin", "value"])

    size = 0
    for line in _lines(path, part):
        held.append(line)
        size += len(line[1])
        if len(held) >= rows or size > 8 * BLOCK:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _ranges(start: dict, end: dict, size: int) -> list[Range]:
    out = []
    for path, to in sorted(end.items()):
        at = start.get(path, 0)
        out += [Range(path, b, min(b + size, to), to, b == at) for b in range(at, to, size)]
    return out


class _Snapshot:
    """What both readers share."""

    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def positions(self, before: dict) -> dict:
        """Of each file the place behind its last whole line; `before`: positions known to be line ends."""
        system, _ = _open(self.path)
        out = dict(before)
        for path, size in _files(self.path).items():
            at = before.get(path, 0)
            if size < at:
                raise ValueError(f"{path} became shorter")
            if size > at:
                with system.open_input_file(path) as file:
                    at = _last_line_end(file, at, size)
            if at:
                out[path] = at
        return dict(sorted(out.items()))


class GrowingStream(DataSourceStreamReader, _Snapshot):
    def __init__(self, options: dict):
        _Snapshot.__init__(self, options)
        self._seen: dict = {}  # line ends found so far, only to search less

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self._seen = self.positions(self._seen)
        return self._seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._seen = {**end, **self._seen}
        return _ranges(start, end, self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class GrowingTable(DataSourceReader, _Snapshot):
    def __init__(self, options: dict):
        _Snapshot.__init__(self, options)

    def partitions(self) -> list[Range]:
        return _ranges({}, self.positions({}), self.range_bytes) or [Range(self.path, 0, 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition) if partition.end else iter(())


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GrowingTable:
        return GrowingTable(dict(self.options))

    def streamReader(self, schema) -> GrowingStream:  # noqa: N802
        return GrowingStream(dict(self.options))


def growing_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (path, begin, value): each whole line of the files once, with its place in bytes."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("rangeBytes", range_bytes).load(path)


def lines_now(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The whole lines that are there now, as a table."""
    spark.dataSource.register(GrowingLines)
    return spark.read.format("growing_lines").option("rangeBytes", range_bytes).load(path)
