"""Best-fit-decreasing packing of tokenised documents.

Pieces go from the longest to the shortest, each into the open sequence with the least room that still takes it. A
segment tree over the possible remaining rooms finds that sequence in logarithmic time. Pieces of one length are alike, and so are
sequences with the same room and history, so the tree places whole runs of both at once: what it needs is the number
of pieces of each length, and what it gives is a plan whose size depends on the capacity, not on the corpus. Each
piece then reads its place off the plan by its number among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import number_within, text_batches, written

#: Tokens of a sequence, and the token that ends a document.
CAPACITY, END = 1024, 2
#: Documents in order are numbered in stretches of 2 ** STRETCH_BITS places.
STRETCH_BITS = 12
#: One of so many texts is tokenised by both libraries.
HELD_AGAINST = 100


class Rooms:
    """A segment tree over remaining rooms 0..capacity that finds the least one that is open and large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        k = self.size + room
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def least(self, room: int) -> int | None:
        """The least open room of at least this size."""
        k = self.size + room
        if self.open[k]:
            return room
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: rows (length, first, per, sequence, offset).

    Pieces of that length, numbered from `first` on up to the next row's first, go `per` to a sequence, from `sequence`
    on, the first of them in each at `offset`.
    """
    rooms, runs = Rooms(capacity), [[] for _ in range(capacity + 1)]  # of each room: runs of sequences [first, end)
    out, new = [], 0

    def add(room: int, first: int, end: int) -> None:
        if first < end and room:
            if not runs[room]:
                rooms.set(room, True)
            runs[room].append((first, end))

    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            room = rooms.least(length)
            if room is None:
                room, per = capacity, capacity // length
                first, end = new, new - (-left // per)
                new = end
            else:
                first, end = runs[room].pop()
                if not runs[room]:
                    rooms.set(room, False)
                per = room // length
            out.append((length, at, per, first, capacity - room))
            full = min(end - first, left // per)
            rest = left - full * per if full < end - first else 0
            add(room - per * length, first, first + full)
            at, left = at + full * per + rest, left - full * per - rest
            if rest:
                add(room - rest * length, first + full, first + full + 1)
                full += 1
            add(room, first + full, end)
    return out


def encoder(tokenizer: str):
    """text -> ids as little-endian 32-bit words, by the tokenizers library or, where its ranks lie beside the file, by
    tiktoken, which gives the same ids faster; texts that spell a special token always go to the former, and so does each
    HELD_AGAINST-th text as well: other ids there are an error."""
    from pathlib import Path

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    own = lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, "<u4")
    ranks = Path(tokenizer).with_suffix(".tiktoken")
    if not ranks.exists():
        return own
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.read_bytes().splitlines())}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    calls = count()

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return own(text)
        ids = np.asarray(fast.encode_ordinary(text), "<u4")
        if next(calls) % HELD_AGAINST == 0 and not np.array_equal(ids, own(text)):
            raise ValueError(f"the ranks beside {tokenizer} give other ids than the tokenizer itself")
        return ids

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, order: Column | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and turn, the document's value of `order`, if there is one. A document's ids end with `end`; longer ones than the capacity
    are cut into pieces of it, of which the first may be shorter. A null text is empty: its ids are `end` alone."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                n = -(-len(ids) // capacity)
                a = 0
                for i in range(n):
                    b = len(ids) - (n - 1 - i) * capacity
                    row.append(k), piece.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
                    a = b
            at = pa.array(row, pa.int32())
            turn = [c.take(at) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *turn], names=["doc_id", "piece", "start", "length", "ids_crc32", "turn"][: 5 + len(turn)])

    turn = [] if order is None else [order.cast("long").alias("turn")]
    return docs.select("doc_id", "text", *turn).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", turn long" * len(turn))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, order: Column | None = None) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Offsets fill each sequence from 0 without gaps. Null and empty texts are pieces of one token; repeated rows are
    packed each; a null doc_id is kept; other columns are ignored. An empty table gives an empty result.

    With an `order` (a long of each document), pieces of one length take their places in that order, and sequences are numbered
    by the earliest document in them.
    """
    rows = written(pieces(docs, tokenizer, capacity, end, order))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length up to the capacity
    steps = plan(counts, capacity)
    lengths = np.array([s[0] for s in steps], np.int64)
    firsts = np.array([s[1] for s in steps], np.int64)
    sorted_ = np.lexsort((firsts, lengths))
    key = (lengths[sorted_] << 44) | firsts[sorted_]
    held = docs.sparkSession.sparkContext.broadcast((key, *(np.array([s[k] for s in steps], np.int64)[sorted_] for k in (2, 3, 4))))
    stretch = None if order is None else F.shiftright("turn", STRETCH_BITS)
    ranked = number_within(rows, ["length"], [*rows.columns[5:], "doc_id", "piece", "start"], "nth", bucket=stretch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, per, sequence, offset = held.value
        for batch in batches:
            length, nth = np.asarray(batch.column("length")), np.asarray(batch.column("nth"))
            at = np.searchsorted(key, (length << 44) | nth, "right") - 1
            k = nth - (key[at] & ((1 << 44) - 1))
            kept = batch.drop_columns("nth")
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence[at] + k // per[at]), pa.array(offset[at] + k % per[at] * length)], names=[*kept.schema.names, "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, rows.schema.add("sequence_id", "long").add("offset", "long"))
    if order is None:
        return placed
    placed = written(placed)
    earliest = placed.groupBy("sequence_id").agg(F.min("turn").alias("turn")).withColumn("all", F.lit(0))
    numbers = number_within(earliest, ["all"], ["turn", "sequence_id"], "number", bucket=F.shiftright("turn", STRETCH_BITS)).select(F.col("sequence_id").alias("of"), "number")
    return placed.join(numbers, F.col("sequence_id") == F.col("of")).select(*rows.columns[:5], F.col("number").alias("sequence_id"), "offset")
