"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; a source's budget falls into one bucket, which alone is refined, twelve bits
a time. A document is taken q whole times and once more if its hash lies under its source's threshold, so thresholds of
larger budgets contain those of smaller ones. Nothing is sorted but the few buckets of each source.

Defined results: a null text has size 0 and is never the reason for a choice; a null source is a source and comes last;
rows that share id and size share a hash and are taken alike; an empty table gives an empty table; sources without words
have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm._util import fresh, lookup, n_words, written

#: Weights by rank of the source, repeating; the factor at which a source's target stops.
WEIGHTS, FACTOR = (5, 2, 1), 3
#: Bits of hash per histogram, and histograms.
BITS, LEVELS = 12, 3


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple = WEIGHTS, factor: int = FACTOR, share: float = 1.0) -> DataFrame:
    """(source, source_size, target): share of all words by weight, none above factor times its size.

    One row per source: with sources by cap/weight, the first k are capped and the rest share what is left by weight."""
    each = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = each.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    caps = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(factor)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    solved = caps.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    common = F.max(F.when(F.col("open"), F.col("level"))).over(every)  # that of the first open source; later ones are lower
    out = solved.withColumn("target", F.least(F.coalesce(common, F.lit(0.0)) * F.col("w"), F.col("cap")))
    return out.select("source", "source_size", "target")


def _bucket(level: int):
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def thresholds(sized: DataFrame, goal: DataFrame, n_sources: int) -> DataFrame:
    """(source, source_size, target, whole, bar): take each document `whole` times, and once more if its hash prefix is below bar."""
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("bar", F.lit(0).cast("long"))
    for level in range(LEVELS):
        rows = lookup(sized, state.select("source", F.col("bar").alias("prefix")), ["source"], "inner", n_sources)
        if level:
            rows = rows.where(F.shiftrightunsigned("h", 64 - BITS * level) == F.col("prefix"))
        found = rows.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        order = Window.partitionBy("source").orderBy("b")
        upto = found.withColumn("upto", F.sum("n").over(order)).withColumn("under", F.col("upto") - F.col("n"))
        met = upto.join(state.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        if level < LEVELS - 1:  # the bucket in which the budget ends, or the last
            edge = F.struct(F.when(F.col("upto") > F.col("rest"), 0).otherwise(1).alias("past"), F.when(F.col("upto") > F.col("rest"), F.col("b")).otherwise(-F.col("b")).alias("o"), "b", "under")
            cut = met.groupBy("source").agg(F.min(edge).alias("e")).select(F.col("source").alias("s"), F.col("e.b").alias("b"), F.col("e.under").alias("under"))
        else:  # at last, the end of a bucket that comes nearest
            ends = F.array(F.struct(F.abs(F.col("under") - F.col("rest")).alias("off"), F.col("b").alias("b")), F.struct(F.abs(F.col("upto") - F.col("rest")).alias("off"), (F.col("b") + 1).alias("b")))
            cut = met.groupBy("source").agg(F.min(F.array_min(ends)).alias("e")).select(F.col("source").alias("s"), F.col("e.b").alias("b"), F.lit(0).cast("long").alias("under"))
        state = (
            state.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("bar", F.shiftleft("bar", BITS) + F.coalesce("b", F.lit(0)))
            .withColumn("rest", F.col("rest") - F.coalesce("under", F.lit(0)))
            .drop("s", "b", "under")
        )
        state = written(state, "mix-state")
    return state.drop("rest")


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, factor: int = FACTOR, share: float = 1.0) -> tuple[DataFrame, DataFrame, int]:
    """(sizes of all documents, thresholds by source, number of sources)."""
    size = n_words(F.col(text))
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(doc_id), size, F.col(text)).alias("h")), "mix-sizes")
    goal = written(targets(sized, weights=weights, factor=factor, share=share), "mix-targets")
    n_sources = goal.count()
    return sized, thresholds(sized, goal, n_sources), n_sources


def copies(h: str = "h"):
    """How often a row with its source's thresholds is taken."""
    return (F.col("whole") + (F.shiftrightunsigned(F.col(h), 64 - BITS * LEVELS) < F.col("bar")).cast("long")).cast("long")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken (words the mix takes, repeats counted)."""
    sized, bars, n = plan(docs, **options)
    out = lookup(sized, bars, ["source"], "left", n).withColumn("copies", copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows without words cost nothing and are left out."""
    _, bars, n = plan(docs, text=text, source=source, doc_id=doc_id, **options)
    size, h, key, times, one = fresh(docs, "mix_size", "mix_h", "mix_source", "mix_times", "mix_one")
    rows = docs.withColumn(size, n_words(F.col(text))).where(F.col(size) > 0).withColumn(h, F.xxhash64(F.col(doc_id), F.col(size), F.col(text))).withColumn(key, F.col(source))
    bars = bars.select(F.col("source").alias(key), F.struct("whole", "bar").alias(times))
    found = lookup(rows, bars, [key], "left", n)
    taken = F.col(times)["whole"] + (F.shiftrightunsigned(F.col(h), 64 - BITS * LEVELS) < F.col(times)["bar"]).cast("long")
    return found.withColumn(one, F.explode(F.array_repeat(F.lit(1), taken.cast("int")))).select(*docs.columns)
