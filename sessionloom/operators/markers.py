"""Which lines contain which of many literals: one pass of an automaton over each line."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

#: Characters of the markers of one automaton, which a task holds; bytes of lines that are given out at once, and of the lines of a block.
AUTOMATON, AT_ONCE, BLOCK = 8_000_000, 32_000_000, 64_000_000

_built: dict[str, Automaton] = {}


class Automaton:
    """The markers (bytes) of a set, found in one pass over a line; an empty marker is in every line."""

    def __init__(self, markers: list[bytes]):
        self.markers, self.trie = markers, ahocorasick.Automaton()
        self.everywhere = [i for i, m in enumerate(markers) if not m]
        for i, m in enumerate(markers):
            if m:
                self.trie.add_word(m.decode("utf-8", "surrogateescape"), i)
        if len(self.trie):
            self.trie.make_automaton()

    def hits(self, line: bytes | None) -> list[int]:
        if line is None:
            return []
        found = {i for _, i in self.trie.iter(line.decode("utf-8", "surrogateescape"))} if len(self.trie) else set()
        return sorted(found.union(self.everywhere))

    def marked(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows once for each marker that their raw (bytes) has, in pieces of bounded size."""
        where, which, size = [], [], 0
        for i, raw in enumerate(rows["raw"]):
            line = raw.as_py()
            for hit in self.hits(line):
                where.append(i)
                which.append(self.markers[hit])
                size += len(line) + len(self.markers[hit]) + 64
                if size >= AT_ONCE:
                    yield _take(rows, where, which)
                    where, which, size = [], [], 0
        if where:
            yield _take(rows, where, which)


def _take(rows: pa.Table, where: list[int], which: list[bytes]) -> pa.RecordBatch:
    return rows.take(pa.array(where, pa.int64())).append_column("marker", pa.array(which, pa.binary())).combine_chunks().to_batches()[0]


def _as_bytes(lines: DataFrame) -> tuple[DataFrame, D.StructType]:
    """Lines with raw as bytes, as text that isn't valid UTF-8 is kept too, and the schema of their hits."""
    fields = [D.StructField("raw", D.BinaryType()) if f.name == "raw" else f for f in lines.schema.fields]
    return lines.withColumn("raw", F.col("raw").cast("binary")), D.StructType([*fields, D.StructField("marker", D.BinaryType())])


def _as_text(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"raw": F.col("raw").cast("string"), "marker": F.col("marker").cast("string")})


def size_of(markers: DataFrame) -> int:
    """Characters of all markers, and one for each."""
    return markers.agg(F.coalesce(F.sum(F.length("marker") + 1), F.lit(0))).first()[0]


def scan(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """lines (a table or a stream with raw, and any other columns) once for each marker that raw contains, without a shuffle. The
    markers, distinct, are of size AUTOMATON at most and are sent to each worker, which builds one automaton of them."""
    held = [bytes(r.m) for r in markers.where("marker is not null").select(F.col("marker").cast("binary").alias("m")).distinct().collect()]
    sent, name = lines.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Automaton(sent.value)
        for batch in batches:
            yield from _built[name].marked(pa.Table.from_batches([batch]))

    rows, schema = _as_bytes(lines)
    return _as_text(rows.mapInArrow(search, schema))


def scan_in_groups(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """As scan(), for a table of lines and markers of any number: groups of markers meet blocks of lines, so each line passes once
    through each group's automaton and neither all markers nor all lines meet in one task."""
    groups = max(1, -(-2 * size_of(markers) // AUTOMATON))  # twice as many as would do, as a hash deals them
    blocks = max(1, -(-(lines.agg(F.coalesce(F.sum(F.octet_length("raw") + 64), F.lit(0))).first()[0]) // BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.drop_columns(["marker_group", "line_block"])
        found = list(Automaton(right["m"].to_pylist()).marked(rows)) if left.num_rows and right.num_rows else []
        empty = rows.slice(0, 0).append_column("marker", pa.array([], pa.binary()))
        return pa.Table.from_batches(found, empty.schema) if found else empty

    rows, schema = _as_bytes(lines)
    dealt = rows.withColumns({"line_block": F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"), "marker_group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    asked = markers.where("marker is not null").select(F.col("marker").cast("binary").alias("m"), deal("marker", groups).alias("marker_group")).distinct()
    asked = asked.withColumn("line_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return _as_text(dealt.groupBy("line_block", "marker_group").cogroup(asked.groupBy("line_block", "marker_group")).applyInArrow(search, schema))
