"""Stores that a stream fills once: finished jobs, consented submissions, and erasure.

foreachBatch may run a batch again after a failure, wholly or behind its first sink. Each store's manifest remembers the
last batch of each stream, so what a store has it doesn't get again, and a token is stored once, whichever batch brings it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentlake.sources.store import Store, keyed
from talentlake.streaming.state import FINAL


def new_tokens(batch: DataFrame, store: Store, token: str, order: str) -> DataFrame:
    """A batch's first row of each token that a store doesn't have. Only tokens of the store are read."""
    first = Window.partitionBy(token).orderBy(order)
    rows = batch.where(F.col(token).isNotNull()).withColumn("nth_", F.row_number().over(first)).where("nth_ = 1").drop("nth_")
    return rows.join(keyed(store.read().select(token)), token, "left_anti").select(*batch.columns)


def finalizer(results: Store, opted_in: Store, token: str = "token", order: str = "at", stream: str = "finalize", withdrawn: Store | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the first final event of each job to results, and of those the completed ones with consent to
    opted_in, but for tokens in `withdrawn`, whose newest version each batch reads.

    The batch is evaluated once: the second store reads what the first one stored of it. A batch that is run again finds
    its number in the stores that have it."""

    def run(batch: DataFrame, number: int) -> None:
        final = batch.where(F.col("status").isin(*FINAL)).withColumn("batch_id", F.lit(number).cast("long"))
        results.append(new_tokens(final, results, token, order), stream, number)
        mine = results.read().where(F.col("batch_id") == number).where("status = 'COMPLETED' and research_consent")
        if withdrawn is not None:
            mine = mine.join(keyed(withdrawn.read().select(token)), token, "left_anti")
        opted_in.append(new_tokens(mine, opted_in, token, order), stream, number)

    return run


def eraser(store: Store, column: str = "withdrawal_hash", code: str = "code", stream: str = "erase") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over withdrawal codes: rows with a code's hash are taken out of a store, once a batch."""

    def run(batch: DataFrame, number: int) -> None:
        store.erase(batch.select(F.sha2(F.trim(code), 256).alias(column)), column, stream, number)

    return run
