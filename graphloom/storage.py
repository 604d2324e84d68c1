"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Most bytes of a table that is broadcast, and rows that are sampled for each range, while an intermediate table is written: all of it passes through the driver, once in every round.
BROADCAST, SAMPLED = 64 * 1024, 20

_own: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that names none gets a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="graphloom-"))
        top = _own[0]
    return top


@contextmanager
def _through_driver(spark: SparkSession) -> Iterator[None]:
    """Holds the session's settings for broadcasts and samples to BROADCAST and SAMPLED; lower ones stay."""
    conf = spark._jsparkSession.sessionState().conf()
    most = {
        "spark.sql.autoBroadcastJoinThreshold": (conf.autoBroadcastJoinThreshold(), BROADCAST), "spark.sql.execution.rangeExchange.sampleSizePerPartition": (conf.rangeExchangeSampleSizePerPartition(), SAMPLED),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": (BROADCAST + 1 if conf.contains("spark.sql.adaptive.autoBroadcastJoinThreshold") else 0, BROADCAST),
    }
    held = {k: (spark.conf.get(k, None), bound) for k, (now, bound) in most.items() if now > bound}
    for k, (_, bound) in held.items():
        spark.conf.set(k, str(bound))
    try:
        yield
    finally:
        for k, (before, _) in held.items():
            spark.conf.unset(k) if before is None else spark.conf.set(k, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """While tables are written, Python gets so many rows at a time: each may hold a whole scene."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df in the shared folder and reads it again: the lineage is cut, and what was written survives lost executors.

    What passes through the driver meanwhile is bounded, so that rounds of joins send it as much for a large table as for a small one.
    """
    path = f"{shared_folder(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    with _through_driver(df.sparkSession):
        df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(df: DataFrame) -> DataFrame:
    """df, after the driver has collected its garbage, Python's first, as that holds on to the JVM's.

    Plans, broadcasts and shuffle files of the jobs so far go now and not when the heap is full, and
    the heap shrinks to what is in use: beside it the JVM needs as much again for code and threads.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """stored(), and aggregates over the rows that come of the same job."""
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), name)
    return out, seen.get


def discard_stored(spark: SparkSession) -> int:
    """Deletes all that this driver has stored so far, and says how many tables. For the end of a job: what still reads them fails afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _written:
        p = path(_written.pop())
        gone += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone
