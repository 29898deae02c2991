"""Workers that stop giving signs of life, told by timers on keyed state.

A sign has a worker, a time and a status. While the status is one of ``RUNNING`` the worker is alive until ``limit`` has passed since the
last sign; then a timer makes it lost, with or without new rows. Any other status is a state of its own, which lasts until the next sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNNING, LIMIT_SECONDS = ("running", "restart", "retry"), 45
CHANGES = "worker string, at timestamp, state string"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.triggerAvailableNowWrapper.enabled": "true",
}


def steps(last: int | None, state: str | None, signs: list[tuple[int, str]], limit: int) -> tuple[list[tuple[int, str]], int | None, str | None]:
    """Changes (time, state) by ``signs`` (time, status), in order, and the last sign and the state after them. Times in microseconds."""
    out = []
    for at, status in signs:
        if state == "alive" and at > last + limit:
            out.append((last + limit, "lost"))
            state = "lost"
        now = "alive" if status in RUNNING else status
        if now != state:
            out.append((at, now))
        last, state = max(at, last or 0), now
    return out, last, state


class Heartbeat(StatefulProcessor):
    def __init__(self, limit_us: int) -> None:
        self.limit = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, state string")

    def _out(self, key: tuple, changes: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if changes:
            at = pd.to_datetime([t for t, _ in changes], unit="us").as_unit("us")
            yield pd.DataFrame({"worker": key[0], "at": at, "state": [s for _, s in changes]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, state = self.seen.get() if self.seen.exists() else (None, None)
        # the rows of one worker in one batch; they come in pieces, each in any order
        signs = pd.concat([r[["us", "place", "status"]] for r in rows]).sort_values(["us", "place"])
        changes, last, state = steps(last, state, list(zip(signs["us"].tolist(), signs["status"].tolist())), self.limit)
        self.seen.update((last, state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "alive":
            # a sign that comes just at the limit is in time
            self.handle.registerTimer((last + self.limit) // 1000 + 1)
        yield from self._out(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, state = self.seen.get() if self.seen.exists() else (None, None)
        if state == "alive":
            self.seen.update((last, "lost"))
            yield from self._out(key, [(last + self.limit, "lost")])

    def close(self) -> None:
        pass


@contextmanager
def timer_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that timers need, for queries started inside: state in RocksDB, and a batch without rows after the last one also where
    a source can't say what is available now. The session's settings are as before afterwards."""
    old = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def worker_states(signs: DataFrame, limit_seconds: float = LIMIT_SECONDS, recorded: bool = False, late: str = "0 seconds") -> DataFrame:
    """worker, at, state: every change of a worker's state, by a stream of ``signs`` (worker, ts, place, status).

    ``place`` orders signs of one time. A worker is lost ``limit_seconds`` after its last sign, once the clock is past that; in a ``recorded``
    log the clock is the latest sign of all, less ``late``, by which signs may be out of order. Start the stream within
    :func:`timer_settings`.
    """
    columns = [F.col("worker").cast("string").alias("worker"), "ts", F.col("place").cast("long").alias("place"), F.unix_micros("ts").alias("us"), "status"]
    if recorded:
        signs = signs.withWatermark("ts", late)
    return signs.select(*columns).groupBy("worker").transformWithStateInPandas(Heartbeat(int(limit_seconds * 1_000_000)), CHANGES, "append", "EventTime" if recorded else "ProcessingTime")
