"""Frames from event streams, and what compares a frame with the one before.

A frame is a tumbling window of event time; its pixels are counts by event type (row) and slot of the window
(column). Late events count until the watermark passes. Pairing consecutive frames needs state: the last frame of
each stream, which is one row of counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events, as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frames(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(frame, event_type, slot, v): counts by hour of each window; works on batches and streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", length).alias("_w"), "event_type", F.hour("ts").alias("slot")).agg(F.count("*").cast("double").alias("v")).select(F.col("_w.start").alias("frame"), "event_type", "slot", "v")


def frame_totals(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(frame, event_type, n, total) of each window and type."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", length).alias("_w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("_w.start").alias("frame"), "event_type", "n", "total")


def frame_changes(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """(event_type, frame, n, change): how each finished frame's count differs from that of the frame before.

    A frame is finished when a later one of its type begins; events for finished frames are late and don't count.
    The state of a type is its open frame's start and count, and the last finished count.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, last = state.get if state.exists else (None, 0, None)
        out = []
        frames_of = pd.concat([pdf["frame"] for pdf in batches]).astype("datetime64[ns]").astype("int64").value_counts().sort_index()
        for frame, count in frames_of.items():
            if start is None or frame == start:
                start, n = frame, n + count
            elif frame > start:
                out.append((key[0], pd.Timestamp(start), n, None if last is None else n - last))
                start, n, last = frame, count, n
        state.update((int(start), int(n), None if last is None else int(last)))
        yield pd.DataFrame(out, columns=["event_type", "frame", "n", "change"]).astype({"change": "Int64", "frame": "datetime64[ns]"})

    framed = events.select("event_type", F.window("ts", length)["start"].alias("frame"))
    return framed.groupBy("event_type").applyInPandasWithState(step, "event_type string, frame timestamp, n long, change long", "start long, n long, last long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that is there now, through the stream in append mode into a Parquet table under ``folder``.

    Results of an append stream are final: windows that the watermark hasn't closed yet aren't in it.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_to_end(spark: SparkSession, path: str, work: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """``work`` over the events of ``path`` that are there now, as if the stream had ended: no window stays open.

    After the events an event from far ahead, of type ``end``, lets the watermark pass all windows but its own. It
    comes in a second run over the same checkpoint, so none of the events is late because of it.
    """
    ends = f"{folder}/end"
    spark.createDataFrame([], EVENTS).write.parquet(ends)
    stream = work(event_stream(spark, path).unionByName(event_stream(spark, ends)))
    run_to_table(stream, folder)
    spark.sql("SELECT -1L AS event_id, timestamp'9000-01-01' AS ts, 0L AS user_id, 'end' AS event_type, 0D AS value, '' AS props").write.mode("append").parquet(ends)
    return run_to_table(work(event_stream(spark, path).unionByName(event_stream(spark, ends))), folder)
