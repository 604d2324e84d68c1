"""Streams: windows over events, folds of commands, continuity of pages as they come, and evidence that is computed once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import shared_folder


def windowed(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value); with ``late`` the time after which a stream drops what comes too late."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at path."""
    import os

    folder, name = os.path.split(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def drained(spark: SparkSession, path: str) -> DataFrame:
    """All windows of a stream that is read to its end once, by way of the shared folder."""
    top = f"{shared_folder(spark)}/graphloom/windows-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out")

    query = windowed(event_stream(spark, path)).writeStream.outputMode("complete").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{top}/out")


def command_revisions(commands: DataFrame) -> DataFrame:
    """(document_id, command_id, revision, is_stale) of a stream of commands (document_id, command_id, expected_revision): the state is a document's revision."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (revision,) = state.get if state.exists else (0,)
        rows = []
        for frame in frames:
            for c, expected in zip(frame.sort_values("command_id").command_id, frame.sort_values("command_id").expected_revision):
                late = not pd.isna(expected) and int(expected) != revision
                revision += not late
                rows.append((key[0], c, revision, late))
        state.update((revision,))
        yield pd.DataFrame(rows, columns=["document_id", "command_id", "revision", "is_stale"])

    return commands.groupBy("document_id").applyInPandasWithState(fold, "document_id long, command_id long, revision long, is_stale boolean", "revision long", "append", GroupStateTimeout.NoTimeout)


def first_evidence(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's pages (cache_key, at, ...), each key once within the watermark: what a cache has yet to compute."""
    return pages.withWatermark("at", late).dropDuplicatesWithinWatermark(["cache_key"])
