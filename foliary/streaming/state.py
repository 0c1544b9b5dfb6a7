"""Jobs as keyed state: metas merged key by key as events arrive, elapsed times, stalls and expiry by timers.

Each job has one value (its last event, when it started and ended) and a map of
its meta in the state store. Timers by event time fire without an event: a job
that has not ended and is silent for `stall` seconds is told as stalled, and one
that is silent for `expiry` seconds leaves the store, with its map. If it is heard
of again it begins anew, in the same batch or in a later one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: What is sent on of a job: times in microseconds, `live` is false once it has left the store.
SCHEMA = "job_id string, last long, meta map<string,string>, started long, ended long, elapsed long, stalled boolean, live boolean"
_S = 1_000_000


class JobState(StatefulProcessor):
    """Rows of a job have us (time in microseconds), event_id, status, k and v (a meta key and its value, null if none)."""

    def __init__(self, start: str, ends: tuple[str, ...], stall: int, expiry: int) -> None:
        self.start, self.ends, self.stall, self.expiry = start, ends, stall * _S, expiry * _S

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "last long, started long, ended long")
        self.meta = handle.getMapState("meta", "k string", "v string, us long, event_id long")

    def _timers(self, last: int, ended: int | None) -> None:
        """Timers of a job's last event in place of those of an earlier one."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-(last + self.expiry) // 1000))
        if ended is None:
            self.handle.registerTimer(-(-(last + self.stall) // 1000))

    def _told(self, key: Any, last: int, started: int | None, ended: int | None, stalled: bool, live: bool = True) -> pd.DataFrame:
        meta = {k[0]: v[0] for k, v in self.meta.iterator()} if live else {}
        until = ended if ended is not None else last + self.stall if stalled else last
        elapsed = until - started if started is not None else None
        return pd.DataFrame({
            "job_id": [key[0]], "last": [last], "meta": [meta], "started": pd.array([started], "Int64"), "ended": pd.array([ended], "Int64"), "elapsed": pd.array([elapsed], "Int64"), "stalled": [stalled], "live": [live],
        })

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """All events of a job in a batch, in their order; a silence of over `expiry` ahead of one ends what was before it."""
        new = pd.concat(rows).sort_values(["us", "event_id"])
        last, started, ended = self.job.get() if self.job.exists() else (None, None, None)
        ahead = new["us"].shift().astype("float64")
        if last is not None:
            ahead.iloc[0] = max(last, 0)
        silent = (new["us"] - ahead > self.expiry).to_numpy().nonzero()[0]
        if len(silent):
            self.meta.clear()
            last = started = ended = None
            new = new.iloc[silent[-1] :]
        if started is None:
            starts = new.loc[new["status"] == self.start, "us"]
            started = int(starts.iloc[0]) if len(starts) else None
        if started is not None and ended is None:
            stops = new.loc[new["status"].isin(self.ends) & (new["us"] >= started), "us"]
            ended = int(stops.iloc[0]) if len(stops) else None
        for k, v, us, event_id in new.loc[new["k"].notna()].drop_duplicates("k", keep="last")[["k", "v", "us", "event_id"]].itertuples(index=False):
            old = self.meta.getValue((k,)) if self.meta.containsKey((k,)) else None
            if old is None or (old[1], old[2]) <= (us, event_id):
                self.meta.updateValue((k,), (v, int(us), int(event_id)))
        last = max(int(new["us"].iloc[-1]), last or 0)
        self.job.update((last, started, ended))
        self._timers(last, ended)
        yield self._told(key, last, started, ended, False)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The later of a job's timers ends it, the earlier finds it stalled."""
        if not self.job.exists():
            return
        last, started, ended = self.job.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= -(-(last + self.expiry) // 1000):
            yield self._told(key, last, started, ended, ended is None, live=False)
            self.meta.clear()
            self.job.clear()
        else:
            yield self._told(key, last, started, ended, True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, start: str, ends: tuple[str, ...], stall: int, expiry: int, late: str = "0 seconds") -> DataFrame:
    """What changes of each job in each batch; `events` has event_id, job_id, ts, status, k and v. Events may come `late`, and the watermark waits that long."""
    timed = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "status", "k", "v").withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(JobState(start, ends, stall, expiry), SCHEMA, "Update", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, as map state and timers need; the setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
