"""State over time: request limits, job life cycles, consent, erasure and clean-up, as batch and as streams.

The batch forms read sorted partitions row by row with a bounded state, so a key that has a third of all events needs no
more memory than any other. Streams with timers are in timers.py, sinks that store once in sinks.py.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requests of one client in a window of seconds, the hours after which a job goes, and the states that end one (fixed values).
MOST_REQUESTS, WINDOW_S, PENDING_H, FINISHED_H = 5, 3600, 3, 24
FINAL = ("COMPLETED", "FAILED")
REMOTE_FINAL = ("COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT")


class Limiter:
    """A sliding log of accepted requests: a request counts against later ones only if it was accepted, up to and
    including `window` seconds later."""

    def __init__(self, most: int, window: int, log=()):
        self.most, self.window, self.log = most, window, deque(log)

    def allow(self, now: int) -> bool:
        while self.log and self.log[0] < now - self.window:
            self.log.popleft()
        if len(self.log) >= self.most:
            return False
        self.log.append(now)
        return True


def limited(events: DataFrame, key: str, epoch: str, order: str, most: int = MOST_REQUESTS, window: int = WINDOW_S) -> DataFrame:
    """events with allowed: each key's requests in order of epoch, then `order`, through a limiter."""
    schema = type(events.schema)([*events.schema.fields]).add("allowed", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, limiter = object(), None
        for b in batches:
            out = []
            for k, t in zip(b[key], b[epoch], strict=True):
                if k != who:
                    who, limiter = k, Limiter(most, window)
                out.append(limiter.allow(int(t)))
            yield b.assign(allowed=pd.Series(out, index=b.index, dtype=bool))

    return events.where(F.col(epoch).isNotNull() & F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, epoch, order).mapInPandas(run, schema)


def trailing_count(events: DataFrame, key: str, epoch: str, window: int = WINDOW_S, slices: int = 8) -> DataFrame:
    """events with n_trailing, all events of the key in the last `window` seconds, this one and those at its second included.

    A key's time is cut into slices of `slices` windows, each with a copy of the window before it, so that a key that has
    a third of all events is spread over as many tasks as it has slices; one row in `slices` is sent twice. Events without
    a time count each other."""
    size = window * slices
    own, copy = "slice_", "copied_"
    while own in events.columns or copy in events.columns:
        own, copy = own + "_", copy + "_"
    at = F.floor(F.col(epoch) / size)
    late = F.col(epoch) >= (at + 1) * size - window
    copies = F.when(late, F.array(F.struct(at.alias("s"), F.lit(False).alias("c")), F.struct((at + 1).alias("s"), F.lit(True).alias("c")))).otherwise(F.array(F.struct(at.alias("s"), F.lit(False).alias("c"))))
    rows = events.select("*", F.inline(copies).alias(own, copy))
    w = Window.partitionBy(key, own).orderBy(epoch).rangeBetween(-window, 0)
    return rows.withColumn("n_trailing", F.count(F.lit(1)).over(w)).where(~F.col(copy)).drop(own, copy)


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's last row, by the given columns; a partial aggregation, so a hot key shuffles one row a task."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def job_states(events: DataFrame, token: str = "token", status: str = "status", order: str = "seq") -> DataFrame:
    """(token, status, n_events) after all events of each job: the first final state holds, else the last state."""
    final = F.col(status).isin(*FINAL)
    return events.groupBy(token).agg(
        F.min_by(F.when(final, F.col(status)), F.when(final, F.col(order))).alias("f"), F.max_by(status, order).alias("l"), F.count(F.lit(1)).alias("n_events")
    ).select(token, F.coalesce("f", "l").alias("status"), "n_events")


def finalized_once(events: DataFrame, token: str, time: str, delay: str = "24 hours") -> DataFrame:
    """The first final event of each job in a stream, however often poll and webhook report it."""
    return events.where(F.col("status").isin(*FINAL)).withWatermark(time, delay).dropDuplicatesWithinWatermark([token])


def expired(jobs: DataFrame, now: Column, updated: str = "updated_at", status: str = "status") -> DataFrame:
    """Jobs to be cleaned up: finished ones after a day, others after three hours. A job without a time stays."""
    hours = F.when(F.col(status).isin(*FINAL), FINISHED_H).otherwise(PENDING_H)
    return jobs.where(F.col(updated) < now - F.make_interval(hours=hours))


def withdrawn(store: DataFrame, codes: DataFrame, column: str = "withdrawal_hash") -> DataFrame:
    """A store without the rows of withdrawal codes (code), which it knows by hash only."""
    hashes = codes.select(F.sha2(F.trim("code"), 256).alias(column)).distinct()
    return store.join(hashes, column, "left_anti").select(*store.columns)


def public_stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("submissions"), F.countDistinct("source_sha256").alias("distinct_cvs"))


def pending(samples: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Samples that no completed row has the keys of."""
    return samples.join(done.select(*keys).distinct(), list(keys), "left_anti")


def overlaid(base: DataFrame, retries: DataFrame, key: str) -> DataFrame:
    """base with the rows of retries in place of its own; retries of unknown keys are left out."""
    known = retries.join(base.select(key), key, "left_semi")
    return base.join(known.select(key), key, "left_anti").unionByName(known)


def by_remote_id(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """(remote_job_id, token): the job of each remote id, that of the least token if there are several."""
    return jobs.join(ids.select("remote_job_id").distinct(), "remote_job_id").groupBy("remote_job_id").agg(F.min("token").alias("token"))


def overridden(local: Column, remote: Column, fields: list[str]) -> Column:
    """A struct with given fields from another where that has them."""
    out = local
    for f in fields:
        out = out.withField(f, F.coalesce(remote[f], local[f]))
    return out


def poll_delay(attempt: Column) -> Column:
    """Seconds before a client asks again: 0.8, four times 2.5, then 5."""
    return F.when(attempt < 1, 0.8).when(attempt < 5, 2.5).otherwise(5.0)
