"""Claims of answers in a stream: the first of a key wins, and a later one when the winner has become stale.

Batches may come in any order within the watermark's delay. A claim waits in its key's state until the watermark has passed
it; only then is it decided, in the order of event time, so the winners are those of the batch form whatever the batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Claims(StatefulProcessor):
    """State of a key: the claims that wait for the watermark, and the last winner until no claim can find it fresh."""

    def __init__(self, stale_ms: int) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["event_id"].notna()]  # a row without an event only moves the clock
        if len(new):
            waiting = {tuple(map(int, w)) for w in self.waiting.get()} if self.waiting.exists() else set()
            waiting |= {(int(a), int(e)) for a, e in zip(new["at"], new["event_id"], strict=True)}
            self.waiting.put(sorted(waiting))
            self.handle.registerTimer(min(waiting)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(map(int, w)) for w in self.waiting.get()) if self.waiting.exists() else []
        last = int(self.last.get()[0]) if self.last.exists() else None
        won = []
        for at, event_id in waiting:
            if at <= now and (last is None or at - last > self.stale_ms * 1000):
                last = at
                won.append(event_id)
        waiting = [w for w in waiting if w[0] > now]
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        if last is not None and now - last > self.stale_ms * 1000:
            last = None  # whatever comes now finds it stale
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        until = [w[0] for w in waiting[:1]] + ([last + self.stale_ms * 1000] if last is not None else [])
        if until:
            self.handle.registerTimer(min(until) // 1000 + 1)
        yield pd.DataFrame({"key": [key[0]] * len(won), "event_id": won})

    def close(self) -> None:
        pass


def claims(stream: DataFrame, stale_minutes: int = 30, delay: str = "3 hours") -> DataFrame:
    """(key, event_id) of the claims that win. stream: key, claimed_at, event_id (a long).

    A claim that comes more than `delay` behind the latest one seen is dropped; a repeated one counts once. A source that goes
    quiet sends a row without event_id now and then, which moves the watermark so that waiting claims are decided.
    """
    rows = stream.select("key", F.col("claimed_at").cast("timestamp").alias("claimed_at"), "event_id", F.unix_micros(F.col("claimed_at").cast("timestamp")).alias("at"))
    out = StructType([StructField("key", stream.schema["key"].dataType), StructField("event_id", stream.schema["event_id"].dataType)])
    return rows.withWatermark("claimed_at", delay).groupBy("key").transformWithStateInPandas(Claims(stale_minutes * 60_000), out, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which state with timers needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
