"""A bitmap of keys in the shared folder, to drop rows before they travel.

A key has two places; a row both of whose places are set may be wanted, any other is not.  The
bitmap has ``BITS_A_KEY`` bits a key and at most ``BITMAP_BITS`` (32 MB), which each Python
worker reads; with more keys it lets more strangers pass, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, store

BITMAP_BITS = 1 << 28
BITS_A_KEY = 16
_SLICE = 20


def _places(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    x, y = a.view(np.uint64), b.view(np.uint64)
    return [(mix(h) & np.uint64(bits - 1)).astype(np.int64) for h in (x, y ^ np.uint64(0x9E3779B97F4A7C15))]


def _positions(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((at >> _SLICE).astype(np.int32))], names=["at", "slice"])

    return run


def _slice(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _SLICE, np.uint8)
    bits[table["at"].to_numpy() & (1 << _SLICE) - 1] = 1
    return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


class Bitmap:
    """The bits, as a Python worker holds them."""

    _held: tuple[str, np.ndarray] | None = None

    @staticmethod
    def write(keys: DataFrame) -> tuple[str, int]:
        """From (a, b); returns the path and the number of bits, a power of two that is bounded."""
        bits = min(BITMAP_BITS, 1 << max(_SLICE, (keys.count() * BITS_A_KEY).bit_length()))
        at = keys.select("a", "b").mapInArrow(_positions(bits), "at bigint, slice int").distinct()  # at most ``bits`` rows
        return store(at.groupBy("slice").applyInArrow(_slice, "slice int, bits binary"), "bitmap"), bits

    @classmethod
    def of(cls, path: str, bits: int) -> np.ndarray:
        if cls._held is None or cls._held[0] != path:
            out = np.zeros(bits // 8, np.uint8)
            fs, at = pyarrow.fs.FileSystem.from_uri(path)
            for row in pq.read_table(at, filesystem=fs).to_pylist():
                first = row["slice"] << (_SLICE - 3)
                out[first : first + (1 << (_SLICE - 3))] = np.frombuffer(row["bits"], np.uint8)
            cls._held = (path, out)
        return cls._held[1]

    @staticmethod
    def filter(path: str, bits: int):
        @F.arrow_udf(T.BooleanType())
        def wanted(a: pa.Array, b: pa.Array) -> pa.Array:
            held, out = Bitmap.of(path, bits), np.ones(len(a), bool)
            for at in _places(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), bits):
                out &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            return pa.array(out)

        return wanted
