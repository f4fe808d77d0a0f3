"""Shared pieces of the training-data operators: shared storage, numpy tokenising and labelled samples.

Nothing here looks at machine-local folders on a cluster: intermediate tables go to the folder that the session
names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at most (a longer text is cut at white space).
PIECE = 1 << 19


# ---------------------------------------------------------------- storage


#: Rows and bytes of an Arrow batch: Python workers hold one batch, so these bound their memory for texts of any length mix.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as a Parquet table in the shared folder and read again: lineage ends there, and a lost executor
    costs a reread. The driver then collects garbage, so that Spark's cleaner removes the shuffle files that made it."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._treeline_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by `written` whose readers are done."""
    for df in tables:
        path = getattr(df, "_treeline_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- tokenising

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 5  # odd and 5 modulo 8: differences of its powers keep nearly all bits
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                out = np.full(size, base & (1 << 64) - 1, np.uint64)
                out[0] = 1
                _POWERS[i] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a run of texts: 64-bit hashes in order, and the text each is of (index into the batch)."""

    hashes: np.ndarray
    doc: np.ndarray
    start: np.ndarray  # byte offsets into ``data``
    end: np.ndarray
    data: np.ndarray
    docs: tuple[int, int]  # first and last text index of this run
    last: bool  # the last text of the run ends in it


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _pieces(data: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first text, last text + 1, from byte, to byte, whether the last text is complete)."""
    i, n, begin = 0, len(at) - 1, 0
    while i < n:
        j = int(np.searchsorted(at, begin + limit, "right")) - 1
        if j > i:
            j = min(j, n)
            yield i, j, begin, int(at[j]), True
            i, begin = j, int(at[j])
            continue
        end, stop = int(at[i + 1]), begin + limit
        while stop < end and not _WS[data[stop]]:  # a cut must not split a word
            ahead = np.flatnonzero(_WS[data[stop : stop + 4096]])
            stop = stop + int(ahead[0]) if len(ahead) else min(end, stop + 4096)
        done = stop >= end
        yield i, i + 1, begin, min(stop, end), done
        begin = min(stop, end)
        if done:
            i += 1


def words(column: pa.Array, lower: bool = True, limit: int = PIECE) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column (A-Z lower-cased), piece by piece.

    A word's hash is a polynomial over random byte values modulo 2^64, finalised; taken from prefix sums, so no loop
    runs over the words.
    """
    data, at = text_buffers(column)
    table = _BYTE_LOWER if lower else _BYTE
    for i, j, a, b, last in _pieces(data, at, limit):
        raw = data[a:b]
        inside = np.zeros(len(raw) + 1, bool)
        np.logical_not(_WS[raw], out=inside[:-1])
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside[:-1]
        edges = at[i:j] - a
        edges = edges[(edges >= 0) & (edges < len(raw))]
        start = inside & ~before
        start[edges] = inside[edges]
        start = np.flatnonzero(start)
        stop = ~inside & before
        stop[edges] = before[edges]
        stop = np.flatnonzero(stop)
        power, inverse = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * power[: len(raw)], out=total[1:])
        h = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
        doc = np.searchsorted(at[i : j + 1], start + a, "right") - 1 + i
        yield Words(h, doc, start, stop, raw, (i, j), last)


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k]
    return mix(out)


# ---------------------------------------------------------------- labels


def remainder(column, n: int):
    """crc32 of an id as text, modulo ``n`` (null: 0, the crc of an empty text)."""
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row per id that has a label; where an id has several, the largest."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )


def bounded_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, those of the smallest hash: the same ids for the same table, in any order."""
    return labels.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(rows)
