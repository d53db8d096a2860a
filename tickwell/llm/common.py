"""Shared helpers: materialised tables and vectorised text arithmetic for Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors: the one named in spark.checkpoint.dir, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tickwell-scratch").rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, name: str, batch: str = "4m") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors.
    While it is written, Arrow batches hold at most `batch` bytes, so that workers stay small beside the executor.
    A table that was written so already is returned as it is."""
    if _WRITTEN.get(id(df), (lambda: None, ""))[0]() is df:
        return df
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = weakref.ref(out), path
    return out


#: id of a materialised table -> itself and its folder.
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def discard(table: DataFrame) -> None:
    """Delete a materialised table that nothing will read again. Anything else is left alone."""
    held, path = _WRITTEN.pop(id(table), (lambda: None, ""))
    if held() is table:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Rounds:
    """The tables of an iteration. The one before the last is deleted when the next has been written."""

    def __init__(self, name: str):
        self.name, self.last = name, None

    def next(self, df: DataFrame) -> DataFrame:
        before, self.last = self.last, materialise(df, self.name)
        if before is not None and before is not self.last:
            discard(before)
        return self.last


def fresh(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as make it differ from all columns (letter case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def trim() -> None:
    """Give memory that Arrow and the C library keep back to the machine, at the end of a task in a worker that
    stays. The second is there on glibc only."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def words(text: Column | str) -> Column:
    """Array of the words of a text column, empty for null or blank text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- numpy on Arrow string buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of codes[start:end], by differences of one running sum."""
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its row offsets (null rows have no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of whole rows with about `most` units each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    fresh = first[:-1].copy()
    fresh[1:] |= ~inside[:-1]
    starts = np.flatnonzero(inside & fresh)
    last = first[1:].copy()
    last[-1] = True
    last[:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-cased, unless asked otherwise) in row order, and each row's first index."""
    starts, ends, at = word_spans(data, offsets)
    return span_hashes(_BYTE_CODE[_LOWER[data] if lower else data], starts, ends), at
