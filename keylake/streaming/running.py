"""The log as a stream: batches are appended, and a running latest row of each key is kept with its expiry.

Event expiry is the row's ttl against the watermark of event time, so results don't depend on the wall clock. Keys
whose newest row never expires (ttl 0) keep their state for good: one row a key, as the table itself has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keylake.log import SCHEMA
from keylake.operators.latest import latest

LATEST = "key string, value string, op string, ttl long, version long, seq long"


def log_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder, in the log's columns."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def append_batches(stream: DataFrame, folder: str, checkpoint: str):
    """A query that appends each micro-batch, its keys reduced to their latest rows, under folder/batch=N; a batch that is run again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latest(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Emits a key's row whenever a greater (version, seq) arrives; the state of a key goes when its row has expired by the watermark."""
    rows = stream.withColumn("at", F.timestamp_micros("version")).withWatermark("at", delay)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        changed = False
        for pdf in parts:
            if len(pdf):
                r = pdf.sort_values(["version", "seq"], kind="stable").iloc[-1]
                row = (int(r["version"]), int(r["seq"]), r["op"], int(r["ttl"]), r["value"])
                if best is None or row[:2] > tuple(best[:2]):
                    best, changed = row, True
        if changed:
            state.update(best)
        if best is not None and best[3]:  # a row that is expired already goes with the next step of the watermark
            state.setTimeoutTimestamp(max(best[3] * 1000, state.getCurrentWatermarkMs() + 1))
        if changed:
            yield pd.DataFrame({"key": [key[0]], "value": [best[4]], "op": [best[2]], "ttl": [best[3]], "version": [best[0]], "seq": [best[1]]})

    return rows.groupBy("key").applyInPandasWithState(update, LATEST, "version long, seq long, op string, ttl long, value string", "update", GroupStateTimeout.EventTimeTimeout)


def without_repeats(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream without rows of a key and version that came before, as far back as the watermark."""
    return stream.withColumn("at", F.timestamp_micros("version")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["key", "version", "seq"]).drop("at")
