"""Keyed state as a stream: what is known of a key is kept by Spark's state store, so a batch reads the state of its own
keys only, whatever there is in all.

Of every event it is said whether its kind differs from that of the key's event before (change detection), how many failed
attempts there were in a row (an attempt counter, which any other kind resets), and how many seconds it came
before the cooldown after the event before was over. A key whose last event is longer ago than the lifetime begins
anew, and a timer clears its state once the watermark has passed that time, so the store holds living keys only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Seconds of the cooldown and of a state's life, in the events' own time; how late an event may come after later ones.
COOLDOWN, LIFETIME, LATE = 60, 6 * 3600, "1 hour"
STATE = "at long, kind string, attempts long"
OUT = "event_id long, user_id long, changed boolean, attempts long, wait_seconds long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Activity(StatefulProcessor):
    """The last event's time and kind and the failures in a row, for each key. Its clock is that of the events."""

    def __init__(self, failed: str = "error", cooldown: int = COOLDOWN, lifetime: int = LIFETIME):
        self.failed, self.cooldown, self.lifetime = failed, cooldown, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def _expiry(self, at: int) -> int:
        return at // 1000 + self.lifetime * 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])  # those of one key in one batch
        held = self.last.get() if self.last.exists() else None
        if held is not None:
            self.handle.deleteTimer(self._expiry(held[0]))
        out = []
        for event_id, at, kind in zip(events["event_id"].tolist(), events["at"].tolist(), events["kind"].tolist(), strict=True):
            if held is not None and at - held[0] > self.lifetime * 1_000_000:
                held = None
            attempts = 0 if kind != self.failed else 1 + (held[2] if held else 0)
            wait = max(0, self.cooldown - (at - held[0]) // 1_000_000) if held else 0
            out.append((event_id, key[0], held is None or held[1] != kind, attempts, wait))
            held = (at, kind, attempts)
        self.last.update(held)
        self.handle.registerTimer(self._expiry(held[0]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def judged(events: DataFrame, processor: Activity | None = None) -> DataFrame:
    """(event_id, user_id, changed, attempts, wait_seconds) of a stream of events (event_id, ts, user_id, event_type). Events of
    a batch are taken in the order of their times, batches as they come. Those without a key, time or id are left out, and
    those that come later than LATE after all else."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).where("user_id is not null and ts is not null and event_id is not null")
    rows = rows.select("event_id", "user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_type", F.lit("")).alias("kind"))
    return rows.groupBy("user_id").transformWithStateInPandas(processor or Activity(), OUT, "append", "eventTime")


def follow(events: DataFrame, out: str, checkpoint: str, processor: Activity | None = None) -> StreamingQuery:
    """Judge all events that are there and end; run again with the same checkpoint, it goes on with those that have come and
    with the state as it was."""
    spark: SparkSession = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        writer = judged(events, processor).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return writer.option("path", out).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
