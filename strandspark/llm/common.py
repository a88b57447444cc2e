"""Helpers shared by the operators: shared storage, byte views of Arrow text, vectorised words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel looks at together; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 21

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, a stored table, marked for broadcast if it is counted to have at most so many rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session (with _ for .) that hold for the jobs run inside."""
    names = {k: k.replace("_", ".") for k in settings}
    before = {k: spark.conf.get(name, None) for k, name in names.items()}
    try:
        for k, name in names.items():
            spark.conf.set(name, settings[k])
        yield
    finally:
        for k, name in names.items():
            spark.conf.unset(name) if before[k] is None else spark.conf.set(name, before[k])


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing reads it any more."""
    for x in list(_written):
        if any(x[1].removeprefix("file://") in f for f in df.inputFiles()[:1]):
            delete(*x)
            _written.remove(x)


def release() -> None:
    """Gives the system back what this process holds free: a Python worker stays after its task, beside the executor's next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `size` bytes of text each (or one longer text), and their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        body, offsets = byte_view(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i), body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(body: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = hash of body[i:j] times base^i."""
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(max(1, len(body)))[0][: len(body)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of body[start:end], well mixed, equal wherever the bytes are equal."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, first): runs of letters, digits and bytes over 127; the words of
    text i are first[i]:first[i + 1]."""
    low = _LOWER[body]
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = _WORD[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]) & (np.arange(len(body) + 1) < len(body)))
    end = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    return low, start, end, np.searchsorted(start, offsets)
