"""Reading appended bytes and bounded tails."""

import os
import random

import pyarrow.fs
import pytest

from sessionloom.sources import sinks, tails
from sessionloom.streaming import streams


def folder(spark):
    path = sinks.shared_folder(spark).removeprefix("file:")
    os.makedirs(path)
    return path


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_streams_read_what_was_appended(spark):
    at, out = folder(spark), sinks.shared_folder(spark)

    def run():
        query = tails.stream_lines(spark, at, range_bytes=7).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((os.path.basename(r.path), r.offset, r.raw) for r in spark.read.schema(tails.SCHEMA).parquet(out).collect())

    append(f"{at}/a.jsonl", b'{"n": 1}\r\nsecond line here\n\n  \nhalf')
    append(f"{at}/b.jsonl", "é漢 \xff\n".encode())
    append(f"{at}/c.txt", b"not a log\n")
    want = [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 10, "second line here"), ("b.jsonl", 0, "é漢 \xff")]
    assert run() == want
    append(f"{at}/a.jsonl", b" a line\nx\n")
    os.makedirs(f"{at}/deep")
    append(f"{at}/deep/d.jsonl", b"new\n")
    want = sorted([*want, ("a.jsonl", 31, "half a line"), ("a.jsonl", 43, "x"), ("d.jsonl", 0, "new")])
    assert run() == want
    assert run() == want  # nothing new


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_ranges_give_each_line_once(tmp_path, size, monkeypatch):
    monkeypatch.setattr(tails, "STEP", 4)
    rng = random.Random(size)
    lines = [bytes(rng.choices(b"abc", k=rng.randint(0, 20))) for _ in range(60)]
    path = str(tmp_path / "f.jsonl")
    append(path, b"\n".join(lines) + b"\nrest")
    system = pyarrow.fs.LocalFileSystem()
    total = os.path.getsize(path)
    last = tails.whole_until(system, path, 0, total)
    assert last == total - 4 and tails.whole_until(system, path, last, total) == last
    got = [x for a in range(0, last, size) for x in tails.lines_of(system, path, a, min(a + size, last), 0, last)]
    assert [line for _, line in got] == lines
    assert [o for o, _ in got] == [sum(len(x) + 1 for x in lines[:i]) for i in range(60)]
    start = len(lines[0]) + 1  # later batches begin at the end of a line
    got = [x for a in range(start, last, size) for x in tails.lines_of(system, path, a, min(a + size, last), start, last)]
    assert [line for _, line in got] == lines[1:]


def test_an_appended_line_costs_its_bytes(tmp_path, monkeypatch):
    path = str(tmp_path / "f.jsonl")
    append(path, b"x" * 99 + b"\n" + b"old line\n" * 100_000)
    read = []

    class Counting:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, p):
            f = self.system.open_input_file(p)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    f.close()

                def read_at(self, n, at):
                    read.append(n)
                    return f.read_at(n, at)

            return File()

    monkeypatch.setattr(tails, "file_system", lambda p: (Counting(pyarrow.fs.LocalFileSystem()), p))
    monkeypatch.setattr(tails, "log_files", lambda p, s: {path: os.path.getsize(path)})
    reader = tails.TailReader({"path": str(tmp_path)})
    start = reader.latestOffset()
    append(path, b"one more\n")
    read.clear()
    end = reader.latestOffset()
    [part] = reader.partitions(start, end)
    assert [b.to_pylist() for b in reader.read(part)] == [[{"path": path, "offset": 900_100, "raw": "one more"}]]
    assert sum(read) <= 2 * len(b"one more\n")


def test_a_shorter_file_is_read_anew(tmp_path):
    path = str(tmp_path / "f.jsonl")
    append(path, b"one\ntwo\n")
    reader = tails.TailReader({"path": str(tmp_path)})
    start = reader.latestOffset()
    os.truncate(path, 0)
    append(path, b"new\n")
    [part] = reader.partitions(start, reader.latestOffset())
    assert (part.start, part.end) == (0, 4)


@pytest.mark.parametrize("most", [1, 4, 5, 12, 1000])
def test_tails_are_bounded(spark, most):
    at = folder(spark)
    text = "first\nsecond é\n\nlast without end"
    append(f"{at}/a.jsonl", text.encode())
    files = spark.createDataFrame([(f"{at}/a.jsonl", 1), (f"{at}/a.jsonl", 2), (f"{at}/gone", 3), (None, 0)], "path string, size long")
    got = [(r.offset, r.raw) for r in tails.read_tails(files, most).collect()]
    data, want, offset = text.encode(), [], 0
    for line in data.split(b"\n"):
        if offset >= len(data) - most and line:
            want.append((offset, line.decode()))
        offset += len(line) + 1
    assert got == want


def test_markers_on_appended_lines(spark):
    at = folder(spark)
    append(f"{at}/a.jsonl", b"has needle one\nnothing\n")
    lines = tails.stream_lines(spark, at).withColumnRenamed("offset", "line_no")
    got = streams.run_to_table(streams.stream_markers(lines, spark.createDataFrame([("needle",)], "marker string"))).collect()
    assert [(r.marker, r.line_no) for r in got] == [("needle", 0)]
