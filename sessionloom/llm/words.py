"""Whole texts of an Arrow batch as arrays: bytes, words and their 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes taken at once; a longer text is taken alone.
CHUNK = 4_000_000
#: Bytes whose words are hashed at once.
SLICE = 1_000_000

_P, _STEP = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space that parts tokens.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
#: All ASCII but letters and digits.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row's begin; a null row is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of few bytes; a long row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0], _powers[1]


def words(text: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes) of each word, and how many words each row has. parting: the bytes between words."""
    inside = ~parting[text]
    n = len(text)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: equal words have equal hashes anywhere; two different ones share
    one with a chance near 2**-64."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # words within a slice of the text, or a longer one
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        first, last = starts[i], ends[i:j].max()
        part, begin, end = text[first:last], starts[i:j] - first, ends[i:j] - first
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin]
        h += (end - begin).astype(np.uint64) * np.uint64(_STEP)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        out[i:j] = h ^ (h >> np.uint64(32))
        i = j
    return out
