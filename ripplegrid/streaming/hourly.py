"""Streaming forms of the hourly aggregates and of the causal window.

Hourly scores carry a watermark, so late events within it still count and state is dropped behind it; the window of the
last steps is a keyed state that survives batches, which is what a carry-over across files amounts to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ripplegrid.schema import TABLES


def events(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Event files as they arrive in a folder."""
    return spark.readStream.schema(TABLES["events"]).option("maxFilesPerTrigger", per_batch).parquet(path)


def tumbling(stream: DataFrame, late: str = "2 hours", every: str = "1 hour", slide: str | None = None) -> DataFrame:
    """entity, hour, score, n per window of event time; slide makes the windows overlap."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", every, slide) if slide else F.window("ts", every), F.col("user_id").alias("entity"))
    return out.agg(F.round(F.sum("value"), 6).alias("score"), F.count("*").alias("n")).select("entity", F.col("window.start").cast("timestamp_ntz").alias("hour"), "score", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """entity, begin, finish, n of runs of events that are less than a gap apart."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap), F.col("user_id").alias("entity")).agg(F.count("*").alias("n"))
    return out.select("entity", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("finish"), "n")


def deduplicated(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, as long as repeats come within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def causal_windows(stream: DataFrame, width: int = 12) -> DataFrame:
    """user_id, event_id, window: the last ``width`` values up to each event, from the events seen so far in order of time.

    The state of a user is its last ``width - 1`` values, so it never grows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, value in zip(rows["event_id"], rows["value"], strict=True):
            kept.append(float(value))
            if len(kept) >= width:
                kept = kept[-width:]
                out.append((key[0], int(event), list(kept)))
        state.update((kept[-(width - 1) :],))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "window"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, window array<double>", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the written table."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
