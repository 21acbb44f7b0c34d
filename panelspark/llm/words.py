"""Word views over whole Arrow batches: starts, ends and 64-bit hashes without a Python object per word.

Texts stay the UTF-8 bytes that Arrow holds. Separators are ASCII, so words can be cut byte-wise. A word's hash is
a polynomial over a random table of its bytes, taken from one prefix sum over the block, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelspark.session import scratch_dir

BLOCK_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_GRAM = np.uint64(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that end a word of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that end a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: evaluated once, lineage cut."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets from 0; null counts as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` text bytes, one row at least; whole rows only."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    give_back()


def give_back() -> None:
    """Return what a finished task's arrays have left in the allocators to the system: a worker that waits for the next task holds it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class PrefixHash:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.take(_BYTE_CODES, data, out=self.sums[1:])
        self.sums[1:] *= powers[:len(data)]
        np.cumsum(self.sums, out=self.sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


class Words:
    """The words of a block: ``starts`` and ``ends`` in ``data``, ``doc`` (row of each), ``first`` (n + 1 word offsets of the rows)."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False):
        data, self.offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        self.rows = len(self.offsets) - 1
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(separators[self.data], out=inside[1:-1])
        head = np.zeros(len(data) + 1, bool)
        head[self.offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (head | ~inside[:-1]))
        self.ends = np.flatnonzero(inside[:-1] & (head | ~inside[1:]))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        return PrefixHash(self.data).of(self.starts, self.ends)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` consecutive items of ``h``, whichever rows they belong to."""
    m = max(0, len(h) - k + 1)
    acc = h[:m] + np.uint64(k)
    for j in range(1, k):
        acc *= _GRAM
        acc += h[j:j + m]
    return mix(acc)


def windows(words: Words, k: int) -> np.ndarray:
    """The word indexes at which ``k`` words of one row start."""
    n = np.maximum(words.counts - k + 1, 0)
    return np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
