"""Words and word windows of many texts at once, as numpy arrays.

Texts are UTF-8 bytes. All hashes are 64-bit: polynomial over a word's bytes,
then a bit mixer, then a polynomial over the words of a window.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that are put into numpy arrays at once; one longer text goes alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_space = np.ones(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words that white space ends.
SPACED = _space
_alnum = np.zeros(256, bool)
_alnum[0x30:0x3A] = _alnum[0x61:0x7B] = _alnum[0x80:] = True
#: Bytes of lower-case words of letters, digits and all beyond ASCII.
ALNUM = _alnum

_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        known = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)) + 1, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        _powers[int(base)] = known if len(known) <= 4 * CHUNK_BYTES else known[: 2 * CHUNK_BYTES]
    return known[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial; differences give hashes of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * powers(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def ranges(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges [start, end) of what ``rolled`` summed."""
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def batches(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes, with the index of the first."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > limit:
            yield first, texts[first:i]
            first, n = i, 0
        n += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Ranges of rows of a text column that hold about ``limit`` bytes each, so that a task
    decodes so much at once, however much Spark sends it; one longer text goes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(first, last)
        first = last


@contextmanager
def small_batches(spark: SparkSession, limit: str = "8m") -> Iterator[None]:
    """For actions inside: Spark sends Python so many bytes at once, so that neither side
    holds buffers of its default of 64 MB for each task. The setting is the session's: the
    first of several jobs at once sets it, and the last to end puts back what was there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with _setting:
        if not _users:
            _before.append(spark.conf.get(key))
            spark.conf.set(key, limit)
        _users.append(limit)
    try:
        yield
    finally:
        with _setting:
            _users.pop()
            if not _users:
                spark.conf.set(key, _before.pop())


_setting, _users, _before = threading.Lock(), [], []


def sliced(rows: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches whose text column ``at`` is cut by ``slices``."""
    for b in rows:
        for part in slices(b.column(at)):
            yield b.slice(part.start, part.stop - part.start)


class Words:
    """The words of some texts: byte ranges, owners and hashes."""

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        self.joined = b" ".join(texts) + b" "
        self.bytes = np.frombuffer(self.joined, np.uint8)
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[1:] = kind[self.bytes]
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        #: Words first[i] .. first[i + 1] are those of text i.
        self.first = np.searchsorted(self.start, self.text_start)

    def hashes(self) -> np.ndarray:
        return ranges(rolled(self.bytes.astype(np.uint64)), self.start, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts in UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def windows(prefix: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words that start at word 0 .. n_words - size."""
    at = np.arange(max(0, n_words - size + 1))
    return ranges(prefix, at, at + size)
