"""Shared helpers: the shared folder, lineage cuts, bounded Arrow batches, and row ids.

The package has to be importable on the executors (installed there, or sent with
``--py-files``), because the Arrow functions refer to module-level kernels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from siltstone.session import prepare, shared_dir, written

#: Bytes of text that a kernel looks at in one step; bounds the temporaries of a task.
STEP_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: the package is shipped, and Arrow batches are limited by bytes."""
    prepare(spark)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (null: empty), without copies if possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row that is longer."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def seeded(seed: int, n: int) -> np.ndarray:
    """Odd pseudo-random 64-bit numbers, the same on every machine."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (multiply-xorshift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class RangeHash:
    """Hashes of any byte range of a buffer in O(1) each: polynomial prefix sums mod 2**64 over
    a random table of byte values; the odd base has an inverse, which makes ranges comparable."""

    def __init__(self, seed: int):
        self.table = seeded(seed, 256)
        self.base = int(seeded(seed + 1, 1)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 1 << 16)
            with np.errstate(over="ignore"):
                for name, value in (("power", self.base), ("back", self.inverse)):
                    steps_ = np.full(size, value, np.uint64)
                    steps_[0] = 1
                    setattr(self, name, np.cumprod(steps_, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.back[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all ranges of ``k`` bytes."""
        n = len(prefix) - k
        return mix64((prefix[k:] - prefix[:n]) * self.back[:n])


__all__ = ["RangeHash", "bounded_batches", "fresh", "mix64", "read_table", "seeded", "shared_dir", "steps", "text_bytes", "written"]
