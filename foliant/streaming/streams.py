"""Event-time windows and stateful limits over streams (additions to the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.streaming.state import TokenBucket


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling or sliding window; ``late`` is the watermark of a stream."""
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    return events.groupBy(F.window("ts", size, slide or size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = "10 minutes", key: str = "user_id") -> DataFrame:
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


class BucketProcessor(StatefulProcessor):
    """One token bucket per key; rows of a batch are taken in time order."""

    def __init__(self, rate: float, capacity: float):
        self.rate, self.capacity = rate, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else (None, None)
        bucket = TokenBucket(self.rate, self.capacity, *held)
        for frame in rows:
            frame = frame.sort_values("at")
            taken = [bucket.consume(float(t)) for t in frame["at"]]
            yield pd.DataFrame({"key": [key[0]] * len(frame), "at": frame["at"].to_numpy(), "allowed": taken})
        self.state.update((bucket.tokens, bucket.at))

    def close(self) -> None:
        pass


def limited(stream: DataFrame, rate: float, capacity: float) -> DataFrame:
    """stream(key, at) with whether each request is allowed."""
    return stream.groupBy("key").transformWithStateInPandas(BucketProcessor(rate, capacity), "key bigint, at double, allowed boolean", "Append", "None")
