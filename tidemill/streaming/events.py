"""Extension: the event log as a stream.

Windowed counts with a watermark that drops late rows, and the bounded memory of each actor as
custom state.  Run with Trigger.AvailableNow they equal the batch operators on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MEMORY = "user_id long, event_id long, memory string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder as a stream with the batch schema."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; rows later than the watermark don't count."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def memories(events: DataFrame, limit: int = 12) -> DataFrame:
    """After each event, the last ``limit`` items of its user; the state holds that many items for each user."""

    def remember(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for event, kind in zip(rows.event_id, rows.event_type, strict=True):
            held = [*held, f"{kind}:{event}"][-limit:]
            out.append((key[0], event, "|".join(held)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "memory"])

    return events.groupBy("user_id").applyInPandasWithState(remember, MEMORY, "items array<string>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there to Parquet, then stop; a restart goes on where it stopped."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
