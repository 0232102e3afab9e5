"""Tables as streams: a table's rows come in the order of their times, over several runs of one query from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talentlake.session import new_path


def replayed(rows: DataFrame, time: str, start: Callable[[DataFrame, str], StreamingQuery], spans: int = 3) -> None:
    """Run a stream over a table: rows of equal spans of time arrive one span after another, and for each the query is
    started anew, with the checkpoint of the run before. start(stream, checkpoint) starts a query that ends by itself.
    Rows without a time come first."""
    spark, root = rows.sparkSession, new_path(rows.sparkSession, "replay")
    seconds = F.col(time).cast("timestamp").cast("double")
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    if first is None:
        first = last = 0.0
    place = F.least(F.floor((seconds - first) / max((last - first) / spans, 1e-6)), F.lit(spans - 1))
    name = "span_"
    while name in rows.columns:
        name += "_"
    rows.withColumn(name, F.coalesce(place, F.lit(0)).cast("int")).write.partitionBy(name).parquet(f"{root}/all")
    for k in range(spans):
        spark.read.parquet(f"{root}/all").where(F.col(name) == k).select(rows.columns).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        finished(start(stream, f"{root}/checkpoint"))


def finished(query: StreamingQuery) -> None:
    """Wait for a stream that ends by itself; an error of its is raised."""
    query.awaitTermination()
