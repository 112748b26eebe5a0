"""Arrow functions over binary columns: features, cut points, LZ4."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import gear

#: Bytes that a kernel works on at once.
STEP_BYTES = 1 << 20


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _steps(column: pa.Array):
    data, offsets = binary_parts(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1))
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, gear.FEATURES).cast(pa.list_(pa.int64()))


def gear_features(content: Column, sample_bits: int = 5) -> Column:
    """12 features as longs with the bits of the unsigned values, in the order of the transforms."""

    def run(column: pa.Array) -> pa.Array:
        parts = [gear.features(d, o, sample_bits) for d, o in _steps(column)]
        return _lists(np.concatenate(parts) if parts else np.zeros((0, gear.FEATURES), np.uint64))

    return F.arrow_udf(run, "array<long>")(content)


def ntransform_features(content: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        parts = [gear.ntransform(d, o) for d, o in _steps(column)]
        return _lists(np.concatenate(parts) if parts else np.zeros((0, gear.FEATURES), np.uint64))

    return F.arrow_udf(run, "array<long>")(content)


def finesse_features(content: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        parts = [gear.finesse(d, o) for d, o in _steps(column)]
        return _lists(np.concatenate(parts) if parts else np.zeros((0, gear.FEATURES), np.int64))

    return F.arrow_udf(run, "array<long>")(content)


def cut_ends(content: Column, average: int) -> Column:
    """Ends of the content-defined pieces; no piece of empty content."""

    def run(column: pa.Array) -> pa.Array:
        ends = [e for d, o in _steps(column) for e in gear.cut_points(d, o, average)]
        return pa.array([e.tolist() for e in ends], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(content)


def lz4(content: Column) -> Column:
    """LZ4 block of the content, or null if it is not smaller."""

    def run(column: pa.Array) -> pa.Array:
        codec = pa.Codec("lz4_raw")
        out = []
        for value in column:
            raw = value.as_buffer() if value.is_valid else None
            packed = codec.compress(raw, asbytes=True) if raw is not None and raw.size else None
            out.append(packed if packed is not None and len(packed) < raw.size else None)
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(content)


def unlz4(payload: Column, codec: Column, size: Column) -> Column:
    """The content of a payload: decompressed to ``size`` bytes, or as it is if the codec is raw."""

    def run(payload_: pa.Array, codec_: pa.Array, size_: pa.Array) -> pa.Array:
        lz4_ = pa.Codec("lz4_raw")
        out = []
        for p, c, n in zip(payload_, codec_, size_):
            out.append(lz4_.decompress(p.as_py(), n.as_py(), asbytes=True) if c.as_py() == "lz4" else p.as_py())
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(payload, codec, size)
