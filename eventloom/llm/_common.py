"""Helpers that the training-data operators share: staging, text chunks as byte arrays, word spans, hashes."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Workers are used again by later stages: what a task has freed goes back to the system, not to a pool of its own.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that one numpy step holds; a longer text is one step of its own.
CHUNK = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; with a local master, where it is unset, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-stage-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def seeds(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        up, down = np.full(n, U64(_BASE)), np.full(n, U64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo 2**64."""
    return _powers(max(20, int(n).bit_length()))


def folded(lower: bool) -> np.ndarray:
    """The random 64-bit value of each byte, A-Z taken as a-z if `lower`."""
    values = seeds(256, 7)
    if lower:
        values[65:91] = values[97:123]
    return values


_FOLD = {True: folded(True), False: folded(False)}


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans, equal hashes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_FOLD[lower][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def _class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of [^\x20\x09-\x0D]: every byte of another code point is one too.
NOT_SPACE = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of [0-9A-Za-z] and of every code point from U+0080.
ALNUM = _class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Letters A-Z a-z and every code point from U+0080.
ALPHA = _class(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a kind that stay in one row, and each row's first run (rows + 1 numbers)."""
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first = inside & ~before
    first[edge] = inside[edge]
    last = np.ones(len(data), bool)
    if len(data):
        last[:-1] = ~inside[1:]
        last[edge[edge > 0] - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, at)
