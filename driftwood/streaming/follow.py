"""A stream source that follows growing files: each line once, when its end arrives.

How far a stream has come is the size of each file at its last look, so looking is listing
and nothing is read on the driver.  Of what has come since, a task emits the lines whose
newline is in its share of the bytes; where such a line begins earlier, before the share or
before the last look, the task reads back to its beginning.  An unfinished last line so
waits for its end, across batches and restarts, and no bytes are carried along.

A file that is shorter than it was has been cut, or replaced, and is read from its beginning.
One that has been cut and has grown beyond where it was by the next look is taken for one
that has grown.  Files that go are forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
#: Bytes to a task, and bytes read at a time when a line's beginning is looked for.
SHARE, BACK = 64 << 20, 64 << 10


@dataclass
class Share(InputPartition):
    """The bytes of a file from ``begin`` up to ``end``."""

    path: str
    begin: int
    end: int


def _opened(path: str):
    system, name = FileSystem.from_uri(path)
    return system.open_input_file(name)


def line_start(file, at: int) -> int:
    """Where the line begins that the byte at ``at`` is in."""
    while at > 0:
        low = max(0, at - BACK)
        file.seek(low)
        newline = file.read(at - low).rfind(b"\n")
        if newline >= 0:
            return low + newline + 1
        at = low
    return 0


def lines_in(file, begin: int, end: int) -> Iterator[bytes]:
    """The lines, without their newlines, whose newlines are from ``begin`` up to ``end``."""
    at = line_start(file, begin)
    file.seek(at)
    rest = b""
    while at < end:
        part = file.read(min(4 << 20, end - at))
        if not part:
            return
        at += len(part)
        first, *more = part.split(b"\n")
        if more:
            yield rest + first
            yield from more[:-1]
            rest = more[-1]
        else:
            rest += first


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _sizes(self) -> dict[str, int]:
        uri = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        system, name = FileSystem.from_uri(uri)
        head = uri[: len(uri) - len(name)] if uri.endswith(name) else "file://"
        found = system.get_file_info(FileSelector(name, recursive=True, allow_not_found=True))
        # names with a leading dot or underscore are of writers at work
        return {head + f.path: f.size for f in found if f.type == FileType.File and f.base_name[:1] not in "._"}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._sizes()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        out = []
        for path, size in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if size < begin else begin
            out += [Share(path, at, min(at + SHARE, size)) for at in range(begin, size, SHARE)]
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[bytes]) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array([partition.begin] * n, pa.int64()), pa.array(rows, pa.binary())], names=["source", "block", "value"])

        held, size = [], 0
        with _opened(partition.path) as file:
            for line in lines_in(file, partition.begin, partition.end):
                held.append(line)
                size += len(line)
                if size >= 4 << 20:
                    yield batch(held)
                    held, size = [], 0
        yield batch(held)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder)``: source (the file), block
    (where the task's share begins) and value (the line's bytes)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "source string, block bigint, value binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of the files in a folder, and of what is appended to them:
    source, block, value, as ``stream_files`` gives them."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).load(path).withColumn("value", F.col("value").cast("string"))
