"""Vectorised views of Arrow text columns: UTF-8 bytes, words and word hashes.

Everything works on whole byte buffers with numpy, in row slices of a bounded
number of bytes, so that memory follows the slice and not the partition. A
single text longer than the bound forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for text whose A-Z are lower-cased.
LETTERS = np.ones(256, bool)
LETTERS[0x00:0x30] = LETTERS[0x3A:0x61] = LETTERS[0x7B:0x80] = False
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[0x09:0x0E] = False
SPACED[0x20] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def settle() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and an executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not every C library has it


_resident: list = [None, None]


def resident(owner: object, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task for one owner; that of another owner is dropped first."""
    if _resident[0] != owner:
        _resident[:] = None, None
        settle()
        _resident[:] = owner, make()
    return _resident[1]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, owner: object = None) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches whose texts come to `limit` bytes, or one longer text. What another owner keeps is dropped."""
    if _resident[0] is not None and _resident[0] != owner:
        _resident[:] = None, None
    try:
        yield from _slices(batches, column, limit)
    finally:
        settle()


def _slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * SLICE_BYTES:
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a slice: start, end (byte positions), count per text and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        self.data, self.offsets = LOWER[data], offsets
        inside = member[self.data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Index of the first word of each text, and the total at the end.
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of `size` consecutive words for each start; those past the end are left out."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(total)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] times, then those of start[1], and so on."""
    total = int(length.sum())
    base = start - (np.cumsum(length) - length)
    return np.repeat(base, length) + np.arange(total)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """A column name that `taken` does not hold in any case."""
    held = {x.lower() for x in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def fields(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
