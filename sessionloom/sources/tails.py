"""Growing log files read by ranges of bytes: a stream reads what was appended, a tail reads what was asked for.

Files are reached through pyarrow's file systems, so a path may be local or in a store that pyarrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range that one task reads, and of one step back in search of the last line's end.
RANGE, STEP = 64 << 20, 1 << 16
SCHEMA = "path string, offset long, raw string"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def log_files(path: str, suffix: str) -> dict[str, int]:
    """Sizes of the files below a folder whose names end in a suffix, by path."""
    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)}


def whole_until(system: fs.FileSystem, path: str, start: int, size: int) -> int:
    """Where the last whole line ends between two offsets, or the start: reads backwards from the end."""
    with system.open_input_file(path) as f:
        at = size
        while at > start:
            low = max(start, at - STEP)
            cut = f.read_at(at - low, low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return start


def lines_of(system: fs.FileSystem, path: str, start: int, end: int, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the lines that begin from start up to end; first and last are ends of lines around them."""
    with system.open_input_file(path) as f:
        at, rest = start, b""
        if start > first:  # the line that runs into the range belongs to the one before
            at = start - 1
            while at < last:
                part = f.read_at(min(STEP, last - at), at)
                cut = part.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(part)
        begin = at
        while at < last and begin < end:
            part = f.read_at(min(max(STEP, end - at), last - at), at)
            if not part:
                return
            at += len(part)
            *done, rest = (rest + part).split(b"\n")
            for line in done:
                if begin >= end:
                    return
                yield begin, line
                begin += len(line) + 1


def as_batches(path: str, rows: Iterator[tuple[int, bytes]], many: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of lines; a carriage return at the end goes, bytes that aren't UTF-8 are replaced, blank lines are left out."""
    held: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([o for o, _ in held], pa.int64()), pa.array([t for _, t in held])], names=["path", "offset", "raw"])

    size = 0
    for offset, line in rows:
        text = line.removesuffix(b"\r").decode("utf-8", "replace")
        if not text.strip():
            continue
        held.append((offset, text))
        size += len(text)
        if len(held) >= many or size > 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int, last: int):
        self.path, self.start, self.end, self.first, self.last = path, start, end, first, last


class TailReader(DataSourceStreamReader):
    """Offsets are the ends of whole lines by file. A file that became shorter is read anew."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.range = options["path"], options.get("suffix", ".jsonl"), int(options.get("range", RANGE))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        system, _ = file_system(self.path)
        ends = {}
        for path, size in sorted(log_files(self.path, self.suffix).items()):
            start = self.known.get(path, 0)
            ends[path] = whole_until(system, path, start if size >= start else 0, size)
        self.known = ends
        return {"files": json.dumps(ends)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after, out = json.loads(start["files"]), json.loads(end["files"]), []
        for path, last in after.items():
            first = before.get(path, 0)
            first = first if first <= last else 0
            out += [Range(path, a, min(a + self.range, last), first, last) for a in range(first, last, self.range)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        yield from as_batches(partition.path, lines_of(system, partition.path, partition.start, partition.end, partition.first, partition.last))


class LogTails(DataSource):
    """spark.readStream.format("log_tails"): lines (path, offset, raw) as they are appended to the files below `path` whose names
    end in `suffix`; `range` bytes to a task. A line is given out once it is whole."""

    @classmethod
    def name(cls) -> str:
        return "log_tails"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def stream_lines(spark: SparkSession, root: str, suffix: str = ".jsonl", range_bytes: int = RANGE) -> DataFrame:
    """A stream of the lines that are appended to log files (path, offset, raw). Each batch reads the new bytes alone."""
    spark.dataSource.register(LogTails)
    return spark.readStream.format("log_tails").option("path", root).option("suffix", suffix).option("range", range_bytes).load()


def read_tails(files: DataFrame, max_bytes: int) -> DataFrame:
    """The whole lines (path, offset, raw) within the last bytes of each file (path, size): no more than those and one byte before
    them are read. A last line without an end is a line. Files that are gone give no rows; repeated paths are read once; null paths
    and other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = file_system(path)
                size = system.get_file_info(inner).size
                if size is None:
                    continue
                low = max(0, size - max_bytes)
                with system.open_input_file(inner) as f:
                    data = f.read_at(size - low + (low > 0), low - (low > 0))
                cut = data.find(b"\n") + 1 if low else 0
                begin = low - (low > 0) + cut
                if low and not cut:
                    continue
                rows, at = [], begin
                for line in data[cut:].split(b"\n"):
                    rows.append((at, line))
                    at += len(line) + 1
                yield from as_batches(path, iter(rows))

    return files.select(F.col("path").cast("string")).where("path is not null").distinct().mapInArrow(run, SCHEMA)
