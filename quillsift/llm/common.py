"""Helpers shared by the corpus operators: shared storage, Arrow buffers, ranks by key."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset (a local
    session) does the engine pick a temporary folder, and removes it at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillsift-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


class _Scopes(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized within is deleted at the end, but for what outlives its scope."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, tag, outlives))


def store(df: DataFrame, tag: str, outlives: bool = False) -> str:
    """Write ``df``; it goes with the innermost scope, or the one around that if it ``outlives`` it, or stays if there is none."""
    path = f"{shared_dir(df.sparkSession)}/quillsift-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _SCOPES.open[:-1] if outlives else _SCOPES.open
    if scopes:
        scopes[-1].append(path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs within, as each is held whole by the executor, too; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(texts: pa.Array, size: int = 1 << 19) -> Iterator[pa.Array]:
    """A string array in consecutive parts of about ``size`` bytes, one row at least; an empty one as it is.

    Array passes over a text hold many bytes for each of its own, so what a worker holds is
    bounded by the part (or by one text), whatever the size of the Arrow batch.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    if not len(texts):
        yield texts
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def list_buffer(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and the flat values of a list array whose null lists count as empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), pc.list_flatten(lists)


_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PRIME_INV = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_WORD = np.zeros(256, bool)
for _c in (*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)):
    _WORD[_c] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of ``values[start:end]`` for all spans, in a few array passes."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_PRIME, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_PRIME_INV, n)[starts] ^ (ends - starts).astype(np.uint64))


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and its row.

    A word is a longest run of ASCII letters, digits and bytes of non-ASCII characters.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True  # a row never continues the last word of the row before it
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (ASCII letters folded to lower case) and row of every word."""
    starts, ends, rows = word_spans(offsets, data)
    return span_hashes(_FOLD[data], starts, ends), rows


def positive(h: Column) -> Column:
    """A hash without its sign, so that its top bits sort as it does."""
    return h.bitwiseAND(F.lit((1 << 63) - 1))


def chunk_bits(rows: int, chunk_rows: int) -> int:
    """Leading bits of a hash that cut so many rows into chunks of about ``chunk_rows``."""
    return max(0, math.ceil(math.log2(max(1, rows) / chunk_rows)))


def ranked(df: DataFrame, key: str, order: Column, bits: list[int], other: int, out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of each row within ``key`` by ``order`` (a 64-bit hash), ties by all columns.

    A window over a hot key would run in one task.  Here the hash range of a key is cut into
    2^bits chunks, ``bits[key]`` (``other`` for a null key), so there are about as many chunks
    as there are keys and full chunks; only their counts are summed over a key, and the rows
    are ranked within their chunk.  Rows that tie in every column are the same to any reader,
    so their order does not matter.
    """
    from pyspark.sql import Window as W

    of = F.coalesce(F.get(F.from_json(F.lit(str(bits)), F.lit("array<int>")), F.col(key).cast("int")), F.lit(other))
    hashed = df.withColumn("__h", positive(order))
    hashed = hashed.withColumn("__c", F.call_function("shiftright", F.col("__h"), F.lit(63) - of).cast("int"))
    counts = hashed.groupBy(key, "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col(key).alias("__k0"), F.col("__c").alias("__k1"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = hashed.join(base, F.col(key).eqNullSafe(F.col("__k0")) & (F.col("__c") == F.col("__k1"))).select(*hashed.columns, "__base")
    w = W.partitionBy(key, "__c").orderBy("__h", *df.columns)
    return joined.withColumn(out, (F.row_number().over(w) - 1 + F.col("__base")).cast("long")).drop("__h", "__c", "__base")
