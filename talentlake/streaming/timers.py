"""Keyed state that ends by itself: job lives and request logs as streams with event-time timers.

State is kept in RocksDB on the executors and is checkpointed there, so it neither fills the heap nor stays for ever: a
timer at the end of each job's retention, and of each client's window, clears it when the watermark passes. What a life is
depends on the events' times alone, not on how they fall into micro-batches.

Defined results: rows without key or time are left out; rows of one time follow by `order`; a repeated row counts as
often as it comes; rows later than the watermark are dropped by Spark; an empty stream gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talentlake.streaming.state import FINAL, FINISHED_H, MOST_REQUESTS, PENDING_H, WINDOW_S, Limiter

#: The state that a stream of changes gives a job which is cleaned up.
EXPIRED = "EXPIRED"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(spark: SparkSession) -> SparkSession:
    """A session whose streams keep their state in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _in_order(rows: Iterator[pd.DataFrame], time: str, order: str) -> pd.DataFrame:
    """A key's rows by time, then order; nulls last."""
    frames = list(rows)
    every = frames[0] if len(frames) == 1 else pd.concat(frames)
    if every[order].dtype.kind in "iuf":
        return every.take(np.lexsort((every[order].to_numpy(), every[time].to_numpy())))
    return every.sort_values([time, order], kind="stable")


class _Lives(StatefulProcessor):
    """One job at a time for each token: its state, when it began, was last changed, and how many events it had. Puts out
    ended jobs or, with changes, each new state."""

    def __init__(self, token: str, status: str, time: str, order: str, hours: tuple[float, float], changes: bool):
        self.names, self.hours, self.changes = (token, status, time, order), hours, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, began long, updated long, n_events long")

    def _end(self, job: tuple) -> int:
        """The last microsecond at which a job still stands."""
        return job[2] + int(self.hours[job[0] in FINAL] * 3_600_000_000)

    def _row(self, job: tuple) -> tuple:
        """What is said of a job that ended."""
        return (EXPIRED, self._end(job)) if self.changes else (*job[:3], self._end(job), job[3])

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        """All rows of a call in one frame, as each frame is a batch on its way to the JVM."""
        names = ("status", "at") if self.changes else ("status", "began_at", "updated_at", "expired_at", "n_events")
        return pd.DataFrame({self.names[0]: [key[0]] * len(out)} | dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, status, time, order = self.names
        every = _in_order(rows, time, order)
        job, out = self.job.get(), []
        job = None if job is None else tuple(job)
        was = None if job is None else self._end(job)
        for s, at in zip(every[status].tolist(), every[time].tolist(), strict=True):
            if job is not None and at > self._end(job):
                out.append(self._row(job))
                job = None
            before = None if job is None else job[0]
            if job is None:
                job = (s, at, at, 1)
            elif job[0] in FINAL:
                job = (*job[:3], job[3] + 1)
            else:
                job = (s, job[1], at, job[3] + 1)
            if self.changes and job[0] != before:
                out.append((job[0], at))
        self.job.update(job)
        end = self._end(job)
        if end != was:
            if was is not None:
                self.handle.deleteTimer(was // 1000 + 1)
            self.handle.registerTimer(end // 1000 + 1)  # in milliseconds, as the watermark
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self.job.get()
        if job is not None:
            self.job.clear()
            yield self._frame(key, [self._row(tuple(job))])


def _jobs(events: DataFrame, token: str, status: str, time: str, order: str, delay: str, hours: tuple[float, float], changes: bool) -> DataFrame:
    kind = dict(events.dtypes)[token]
    rows = events.select(token, status, order, F.col(time).cast("timestamp").alias("at_")).where(F.col(token).isNotNull() & F.col("at_").isNotNull())
    rows = rows.withWatermark("at_", delay).withColumn("micros_", F.unix_micros("at_"))
    times = ["at"] if changes else ["began_at", "updated_at", "expired_at"]
    schema = f"{token} {kind}, status string, {', '.join(f'{c} long' for c in times)}" + ("" if changes else ", n_events long")
    out = rows.groupBy(token).transformWithStateInPandas(_Lives(token, status, "micros_", order, hours, changes), schema, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


def job_lives_stream(
    events: DataFrame, token: str, status: str, time: str, order: str, delay: str = "0 seconds", pending_h: float = PENDING_H, finished_h: float = FINISHED_H
) -> DataFrame:
    """A row for each job that is cleaned up: (token, status, began_at, updated_at, expired_at, n_events).

    A job stands for pending_h hours after its last change, or finished_h after its first final state, which no later
    event changes; the first event after that begins a new one. It is put out when an event or the watermark passes."""
    return _jobs(events, token, status, time, order, delay, (pending_h, finished_h), changes=False)


def job_states_stream(
    events: DataFrame, token: str, status: str, time: str, order: str, delay: str = "0 seconds", pending_h: float = PENDING_H, finished_h: float = FINISHED_H
) -> DataFrame:
    """Each change of a job's state, once: (token, status, at). What follows a final state changes nothing; a job that is
    cleaned up ends with EXPIRED."""
    return _jobs(events, token, status, time, order, delay, (pending_h, finished_h), changes=True)


class _Requests(StatefulProcessor):
    """A client's accepted requests of the last window."""

    def __init__(self, key: str, epoch: str, order: str, most: int, window: int):
        self.names, self.most, self.window = (key, epoch, order), most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "epoch long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, epoch, order = self.names
        every = _in_order(rows, epoch, order)
        limiter = Limiter(self.most, self.window, [int(x[0]) for x in self.log.get()] if self.log.exists() else ())
        out = {c: every[c].tolist() for c in self.names} | {"allowed": [limiter.allow(int(t)) for t in every[epoch]]}
        if limiter.log:
            self.log.put([(t,) for t in limiter.log])
            end = (limiter.log[-1] + 2 * self.window) * 1000 + 1  # in the stream's times, which are a window later
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            self.handle.registerTimer(end)
            self.timer.update((end,))
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        self.timer.clear()
        yield from ()


def limited_stream(events: DataFrame, key: str, epoch: str, order: str, most: int = MOST_REQUESTS, window: int = WINDOW_S, delay: str = "0 seconds") -> DataFrame:
    """(key, epoch, order, allowed): requests through a sliding log a client. A log holds `most` times at most and goes when
    its window has passed without an accepted request. The stream's times are a window later than the requests', as Spark
    takes rows of the epoch itself as late."""
    kinds = dict(events.dtypes)
    rows = events.select(key, epoch, order).where(F.col(key).isNotNull() & F.col(epoch).isNotNull()).withColumn("at_", F.timestamp_seconds(F.col(epoch) + window)).withWatermark("at_", delay)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, epoch, order)) + ", allowed boolean"
    return rows.groupBy(key).transformWithStateInPandas(_Requests(key, epoch, order, most, window), schema, "Append", "EventTime")
