"""Freshness that moves on by itself: sensors turn stale and offline as time passes, without another reading.

A sensor's state is its last arrival and the status that was told of it, one row a sensor. A timer is set for the moment at which its status will
change next; when it fires, the new status is a row of the stream. Long after a sensor went offline its state is purged,
as it is at once for a sensor whose last row says so.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Whole seconds up to which a sensor is online, and stale (fixed values).
ONLINE, STALE = 600, 1800
#: Seconds after which nothing is kept of a sensor that sends nothing.
FORGOTTEN = 30 * 86_400
SCHEMA = "sensor_id string, status string, age_seconds long, at_ms long"


def status_of(age: int, online: int, stale: int) -> str:
    return "online" if age <= online else "stale" if age <= stale else "offline"


class Freshness(StatefulProcessor):
    def __init__(self, online: int = ONLINE, stale: int = STALE, forgotten: int = FORGOTTEN):
        self.limits, self.forgotten = (online, stale), forgotten

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "received_ms long, status string")

    def _moved(self, key: tuple, received: int, told: str | None, now: int) -> Iterator[Row]:
        """Tells a status that is new, and sets the timer of the next one."""
        age = max(0, (now - received) // 1000)
        status = status_of(age, *self.limits)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a limit holds for its whole second
        after = next((limit + 1 for limit in self.limits if age <= limit), self.forgotten)
        if status == "offline" and age >= self.forgotten:
            self.last.clear()
        else:
            self.last.update((received, status))
            self.handle.registerTimer(max(now + 1, received + 1000 * after))
        if status != told:
            yield Row(sensor_id=key[0], status=status, age_seconds=age, at_ms=now)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        newest = max(((r["received_ms"], bool(r["purge"])) for r in rows if r["received_ms"] is not None), default=None)
        if newest is None:
            return
        before = self.last.get() if self.last.exists() else None
        received, purge = newest
        if before and before[0] > received:
            return
        if purge:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.clear()
            return
        yield from self._moved(key, received, before[1] if before else None, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            received, told = self.last.get()
            yield from self._moved(key, received, told, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def transitions(readings: DataFrame, online: int = ONLINE, stale: int = STALE, forgotten: int = FORGOTTEN) -> DataFrame:
    """(sensor_id, status, age_seconds, at_ms): a row whenever a sensor's status changes, by arrival or by time.

    ``readings`` is a stream of sensor_id, received_at, and optionally ``purge``, which forgets the sensor. The session's
    state store has to be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    purge = F.coalesce("purge", F.lit(False)) if "purge" in readings.columns else F.lit(False)
    slim = readings.select(F.col("sensor_id").cast("string"), F.unix_millis(F.col("received_at").cast("timestamp")).alias("received_ms"), purge.alias("purge"))
    return slim.groupBy("sensor_id").transformWithState(Freshness(online, stale, forgotten), SCHEMA, "Update", "ProcessingTime")
