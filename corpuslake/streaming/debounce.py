"""Debounced change events: sessions that close after a quiet gap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(events: DataFrame, key: str, path: str, ts: str = "ts", gap: str = "5 seconds", watermark: str | None = None) -> DataFrame:
    """Per ``key`` and session: ``first``, ``last``, ``n_events``, ``n_pending`` (distinct paths).

    Works on batches and streams; on a stream ``watermark`` is how late events may come, and a session
    is emitted once the watermark has passed its end.
    """
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("__ts", watermark)
    grouped = rows.groupBy(key, F.session_window("__ts", gap).alias("w"))
    return grouped.agg(F.min("__ts").alias("first"), F.max("__ts").alias("last"), F.count(F.lit(1)).alias("n_events"), F.size(F.collect_set(path)).cast("long").alias("n_pending")).drop("w")


class Debounce(StatefulProcessor):
    """Holds the pending paths of a key and starts its timer anew at each event; fires once it has been quiet for ``gap`` milliseconds.

    Paths are a map in the state store, read key by key, so a key with very many pending files is no larger in memory than its
    timer. Times are microseconds. With event time the timer follows the watermark and an event beyond the gap
    closes what is open; without, it follows the clock and first and last are when events were seen. There only the timer closes: an event
    is seen when its micro-batch starts, so a slow micro-batch before it looks like a gap that the events themselves don't have.
    """

    def __init__(self, gap: int, event_time: bool):
        self.gap, self.event_time = gap, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long, pending long, timer long")
        self.pending = handle.getMapState("pending", "path string", "n long")

    def _fired(self, key) -> pd.DataFrame:
        first, last, n, pending, _ = self.open.get()
        self.open.clear()
        self.pending.clear()
        return pd.DataFrame({"key": [key[0]], "first": [pd.Timestamp(first, unit="us")], "last": [pd.Timestamp(last, unit="us")], "n_events": [n], "n_pending": [pending]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs() * 1000
        came = pd.concat(list(rows)) if self.event_time else None
        came = came.sort_values("ts", kind="stable")[["ts", "path"]].itertuples(index=False) if self.event_time else ((now, path) for batch in rows for path in batch["path"])
        state = self.open.get() if self.open.exists() else None
        timer = state[4] if state else None
        for ts, path in came:
            at = ts if now is not None else int(ts.value // 1000)
            if self.event_time and state and at - state[1] > self.gap * 1000:
                self.open.update((*state[:4], timer))
                yield self._fired(key)
                state = None
            state = state or (at, at, 0, 0, 0)
            new = path is not None and not self.pending.containsKey((path,))
            if new:
                self.pending.updateValue((path,), (1,))
            state = (min(state[0], at), max(state[1], at), state[2] + 1, state[3] + new, 0)
        if state:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = state[1] // 1000 + self.gap + 1
            self.handle.registerTimer(timer)
            self.open.update((*state[:4], timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and self.open.get()[4] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._fired(key)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, path: str, gap: float = 5.0, ts: str | None = None, watermark: str = "0 seconds") -> DataFrame:
    """A stream of the sessions of ``events`` as they close: ``key``, ``first``, ``last``, ``n_events``, ``n_pending``.

    A session closes after ``gap`` seconds without an event: by the clock, or with a column ``ts`` by the watermark over it. Null paths are events
    without a pending file. Events of one micro-batch are taken in order of time; those of a key in one task, as a timer is one thing.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [F.col(key).cast("string").alias("key"), F.col(path).cast("string").alias("path")]
    rows = events.select(*columns) if ts is None else events.select(*columns, F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    schema = "key string, first timestamp, last timestamp, n_events long, n_pending long"
    return rows.groupBy("key").transformWithStateInPandas(Debounce(round(gap * 1000), ts is not None), schema, "Append", "ProcessingTime" if ts is None else "EventTime")
