"""Changes that are handed on once their file has been quiet for a while."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHAPE = "rel string, change string, events long, first_at timestamp, last_at timestamp"


def net(first: str, last: str) -> str:
    """What a sequence of changes of one file comes to. A deletion is never lost, even of a file that came up in between."""
    if last == "deleted":
        return "deleted"
    if first == "created":
        return "created"
    return "modified"


def _text(at: datetime.datetime | None) -> str:
    return at.replace(tzinfo=None).isoformat(" ", "microseconds") if at else ""


def _time(text: str) -> datetime.datetime | None:
    return datetime.datetime.fromisoformat(text) if text else None


class Quiet(StatefulProcessor):
    """Keeps the first and the last change of a file; a timer that every change puts off hands them on."""

    def __init__(self, milliseconds: int):
        self.milliseconds = milliseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "first string, last string, events long, first_at string, last_at string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        new = sorted(((_text(r.at), r.change) for r in rows), key=lambda x: x[0])  # state gives timestamps back in another zone, texts as they were
        if self.pending.exists():
            first, last, n, first_at, last_at = self.pending.get()
            if first_at > new[0][0]:
                first, first_at = new[0][1], new[0][0]
            if last_at <= new[-1][0]:
                last, last_at = new[-1][1], new[-1][0]
        else:
            (first_at, first), (last_at, last), n = new[0], new[-1], 0
        self.pending.update((first, last, n + len(new), first_at, last_at))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if not self.pending.exists():
            return iter(())
        first, last, n, first_at, last_at = self.pending.get()
        self.pending.clear()
        return iter([Row(rel=key[0], change=net(first, last), events=n, first_at=_time(first_at), last_at=_time(last_at))])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, seconds: float = 1.0) -> DataFrame:
    """A stream of (rel, change, at) as one row for each file and burst: rel, change, events, first_at, last_at, `seconds` after its last change.

    State is kept by file, so a busy file holds up no other. Start the query within state_store().
    """
    return changes.groupBy("rel").transformWithState(statefulProcessor=Quiet(int(seconds * 1000)), outputStructType=SHAPE, outputMode="Append", timeMode="ProcessingTime")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, as timers need; the session's own choice stands again afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
