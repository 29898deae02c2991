"""A stream of the lines that are appended to log files, by byte offsets of its own.

``spark.readStream.format("log_tail").option("path", folder or file)`` gives file, position (byte offset of the line) and line. An offset has
the end of the last whole line of each file, so an unfinished last line is carried until its end is there. A file that is shorter than it was,
or begins with another line, has been truncated or replaced and is read anew from its start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from factloom.sources.files import file_system

#: Bytes of a file that one task reads, and that are looked at together.
SPLIT_BYTES, _CHUNK = 64 << 20, 1 << 20
_SCHEMA = pa.schema([("file", pa.string()), ("position", pa.int64()), ("line", pa.string())])


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file; ``whole`` if a line begins at ``start``."""

    file: str
    start: int
    end: int
    whole: bool


def last_line_end(stream, size: int) -> int:
    """Offset behind the last newline among the first ``size`` bytes, 0 if there is none."""
    end = size
    while end:
        start = max(0, end - _CHUNK)
        stream.seek(start)
        at = stream.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def first_line_mark(stream, end: int) -> int | None:
    """Checksum of the first line, None if no line is whole."""
    if not end:
        return None
    stream.seek(0)
    mark = 0
    while chunk := stream.read(_CHUNK):
        at = chunk.find(b"\n")
        mark = zlib.crc32(chunk if at < 0 else chunk[:at], mark)
        if at >= 0:
            break
    return mark


def ranges(before: dict, after: dict, split: int = SPLIT_BYTES) -> list[Range]:
    """What has to be read between two offsets."""
    found = []
    for file, (end, mark) in sorted(after.items()):
        start, old = before.get(file, (0, None))
        if start > end or (start and old != mark):
            start = 0
        found += [Range(file, at, min(at + split, end), at == start) for at in range(start, end, split)]
    return found


def lines(stream, part: Range) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of each line that begins in the range."""
    # whether a line begins at the start is told by the byte before
    at = part.start if part.whole else part.start - 1
    stream.seek(at)
    held, skip = b"", not part.whole
    while True:
        chunk = stream.read(_CHUNK)
        if not chunk:
            return
        held += chunk
        *done, held = held.split(b"\n")
        for line in done:
            if not skip:
                if at >= part.end:
                    return
                yield at, line
            skip = False
            at += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"].rstrip("/"), int(options.get("split_bytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow.fs import FileSelector, FileType

        fs, path = file_system(self.path)
        here = fs.get_file_info(path)
        infos = fs.get_file_info(FileSelector(path, recursive=True)) if here.type == FileType.Directory else [here]
        found = {}
        for info in infos:
            if info.type == FileType.File and not info.base_name.startswith(("_", ".")):
                with fs.open_input_file(info.path) as stream:
                    end = last_line_end(stream, stream.size())
                    found[info.path] = [end, first_line_mark(stream, end)]
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(start, end, self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.file) as stream:
            for at, line in lines(stream, partition):
                rows.append((partition.file, at, line.decode("utf-8", "replace")))
                held += len(line)
                if held > _CHUNK or len(rows) == 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


class LogTail(DataSource):
    """Options: path of a file or folder; split_bytes that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, position long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def appended_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, position and line of every whole line under ``path``, as it is appended."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("split_bytes", str(split_bytes)).load()
