"""Helpers that several operators share: tables, checked broadcasts, byte hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Spark's own row format up to which the small side of a join is broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_ODD = np.uint64(0xD1342543DE82EF95)
_powers: dict[np.uint64, np.ndarray] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: str):
    """The bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def broadcast_checked(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of ``row_bytes`` fit, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, giving unused memory back at its end: Spark keeps Python workers for the next task, of whatever stage."""

    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def binary_values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow column, without a copy per row; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"")
    large = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data, offsets.astype(np.int64)


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[:] = base
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class RollingHash:
    """64-bit hashes of any slice of ``data``: equal slices, equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(n, _BASE), out=self.sums[1:])
        self.back = powers(n + 1, _INVERSE)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all slices of ``width`` bytes."""
        return mix((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def find_words(
    data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, fold: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts that ``offsets`` cut out of ``data``, A to Z counted as a to z unless ``fold`` is off.

    ``letters`` says for each byte whether words are made of it. Returns the (lower-cased) bytes, the words' starts and
    stops in them, and for each text the number of words before it (one entry more than texts).
    """
    data = data[offsets[0] : offsets[-1]]
    begin = offsets - offsets[0]
    if fold:
        data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    inside = letters[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = begin[:-1][begin[:-1] < len(data)]
    first[heads] |= inside[heads]
    tails = begin[1:][begin[1:] > 0] - 1
    last[tails] |= inside[tails]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, start, stop, np.searchsorted(start, begin)


def hash_runs(code: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` neighbouring words, from the words' own hashes."""
    n = max(0, len(code) - length + 1)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = out * _ODD + code[j : n + j]
    return mix(out)


def slices(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Binary column of the given slices of ``data``."""
    size = stop - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
