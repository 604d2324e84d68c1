"""Exchanges of packed numpy columns.

Hash joins over every rolling window would shuffle a row for each window. Tasks send one
binary value for each bucket instead: document ids as narrow deltas, other columns as they are.
A bucket is a function of the hash alone, so each value's entries meet in one task; entries that
agree are merged before they are sent, so a value that all documents hold costs one entry a task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import tidied
from .bytescan import lean_task

__all__ = ["BLOBS", "blob_filter", "buckets", "deal", "doc_bucket", "doc_bucket_column", "gather", "id_filter", "maybe_rows", "narrow", "pack", "packed_column", "partitions", "read_column", "small_batches", "stored", "stored_lean", "table", "unpack", "with_maybe"]

BLOBS = "part int, blob binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


#: Buckets for each shuffle partition: Spark reads several in a task, which holds one of them at a time.
BUCKETS_A_PARTITION = 2


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(spark: SparkSession) -> int:
    """Twice as many buckets as the session has shuffle partitions, so that a bucket is a part of what a task is meant to hold."""
    return BUCKETS_A_PARTITION * partitions(spark)


def narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


#: Kind of a column that holds one value throughout.
_SAME = b"="


def packed_column(c: np.ndarray) -> bytes:
    """A column's kind and values; one of the same value throughout takes the place of one."""
    if c[0] == c[-1] and bool((c == c[0]).all()):
        return _SAME + c.dtype.char.encode() + c[:1].tobytes()
    return c.dtype.char.encode() + c.tobytes()


def read_column(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n values of the column that begins at a place, and where it ends."""
    same = blob[at : at + 1] == _SAME
    at += same
    t = np.dtype(blob[at : at + 1].decode())
    if same:
        return np.full(n, np.frombuffer(blob, t, 1, at + 1)[0], t), at + 1 + t.itemsize
    return np.frombuffer(blob, t, n, at + 1), at + 1 + n * t.itemsize


def pack(docs: np.ndarray, *columns: np.ndarray) -> bytes:
    """docs must ascend."""
    deltas = narrow(np.diff(docs, prepend=docs[:1]))
    return b"".join((struct.pack("<qqB", len(docs), int(docs[0]), len(columns)), packed_column(deltas), *map(packed_column, columns)))


def unpack(blob: bytes) -> list[np.ndarray]:
    n, base, more = struct.unpack_from("<qqB", blob)
    at, out = 17, []
    for _ in range(more + 1):
        column, at = read_column(blob, at, n)
        out.append(column)
    out[0] = base + np.cumsum(out[0].astype(np.int64))
    return out


def gather(blobs: pa.ChunkedArray | pa.Array, kinds: tuple) -> list[np.ndarray]:
    """All blobs' columns, end to end; kinds: the dtypes if there is none."""
    got = [unpack(b.as_buffer().to_pybytes()) for b in blobs]
    return [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, k) for k in kinds]


def table(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_SCHEMA)


def deal(parts: np.ndarray, docs: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, blob) rows of entries dealt out by parts."""
    if not len(docs):
        return []
    if (docs[1:] < docs[:-1]).any():
        o = np.argsort(docs, kind="stable")
        parts, docs, columns = parts[o], docs[o], [c[o] for c in columns]
    o = np.argsort(parts.astype(np.uint16) if int(parts.max()) < 65536 else parts, kind="stable")
    parts, docs, columns = parts[o], docs[o], [c[o] for c in columns]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))), len(parts))
    return [(int(parts[a]), pack(docs[a:b], *(c[a:b] for c in columns))) for a, b in zip(cuts[:-1], cuts[1:])]


def doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    return (docs % 1000003 * 7919 // 64) % n


def doc_bucket_column(doc_id: Column, n: int) -> Column:
    return ((F.floor(F.pmod(doc_id, F.lit(1000003)) * 7919 / 64)) % n).cast("int")


#: Bits of the filter of document ids (a prime): 4 MB at most, whatever the number of ids.
FILTER_BITS = 33_554_393
_PAGE = 32768


def _bit(doc_id: Column) -> Column:
    return F.pmod(doc_id, F.lit(FILTER_BITS))


def id_filter(ids: DataFrame) -> DataFrame:
    """A bitmap of ``ids`` (column doc_id): 1024 pages of 4 KB at most."""
    h = ids.select(_bit(F.col("doc_id")).alias("h"))
    return h.groupBy((F.col("h") / _PAGE).cast("int").alias("__page")).agg(F.bitmap_construct_agg(F.col("h") % _PAGE).alias("__bits"))


def blob_filter(blobs: DataFrame) -> DataFrame:
    """The same of all documents that packed rows name; each task sends its pages, 1024 at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1024 * _PAGE, bool)
        for batch in batches:
            for b in batch.column(0):
                bits[np.unique(unpack(b.as_buffer().to_pybytes())[0]) % FILTER_BITS] = True
        pages = bits.reshape(1024, _PAGE)
        used = np.flatnonzero(pages.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([p.tobytes() for p in np.packbits(pages[used], axis=1, bitorder="little")], pa.binary())], names=["__page", "__bits"])

    return blobs.select("blob").mapInArrow(lean_task(task), "__page int, __bits binary").groupBy("__page").agg(F.bitmap_or_agg("__bits").alias("__bits"))


def with_maybe(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Adds __maybe: false only for rows whose doc_id is surely not in the bitmap. Its bound is FILTER_BITS, so it is broadcast."""
    h = _bit(F.col("doc_id"))
    return (
        df.withColumn("__page", (h / _PAGE).cast("int")).withColumn("__at", h % _PAGE)
        .join(F.broadcast(bitmap), "__page", "left")
        .withColumn("__maybe", F.coalesce(F.expr("shiftright(cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1") == 1, F.lit(False)))
        .drop("__page", "__at", "__bits")
    )


def maybe_rows(df: DataFrame, bitmap: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, __maybe): the same of rows with columns of any names, each whole in the struct ``row``."""
    return with_maybe(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id")), bitmap)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as of ``storage``; a corpus operator is a row of jobs, and after each the driver gives back what it took."""
    return tidied(storage.stored(df, name))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """While tables are written, Python gets so many rows at a time: whole texts or sets are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_lean(df: DataFrame, name: str) -> DataFrame:
    with small_batches(df.sparkSession):
        return stored(df, name)
