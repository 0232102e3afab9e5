"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, in DataFrame functions alone.

A text is cut into sections (at blank lines), paragraphs (lines) and leaves (sentences, cut at LEAF code points where a
sentence is longer). A node's digest is the SHA-256 of its children's digests, a leaf's that of its text; no code point
is outside a leaf, so equal roots mean equal texts. The printed fingerprint is

    root ":" section ";" section ...    section = paragraph "," paragraph ...    paragraph = leaf "-" leaf ...

with leaves cut to 8 hex digits: two roots test equality, differing branches show where texts differ, and shared leaves
give a likeness.

To meet the next document, texts go once through a shuffle into ranges of doc_id, each a window; every range also gets
a copy of the first row of the range after it. Ranges come from approximate quantiles (RANGES at most).

Defined results: a null text counts as empty, with no leaf; likeness is 1 for equal fingerprints and else 0 if one has no
leaf; rows of equal id follow each other by text; a null id comes last; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest leaf, in code points.
LEAF = 32
LEAVES = r"[^.!?]{1,%d}[.!?]*\x20*|[.!?]+\x20*" % LEAF
#: Documents per range, in the mean, and ranges at most.
RANGE_DOCS, RANGES = 1024, 65_535
LOWEST = -(1 << 63)


def tree(text: Column) -> Column:
    """Sections of a text, each (digest, branch): the digest of its subtree and its printed branch."""

    def paragraph(p: Column) -> Column:
        hashes = F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), lambda x: F.sha2(x.cast("binary"), 256))
        return F.struct(F.sha2(F.array_join(hashes, "").cast("binary"), 256).alias("digest"), F.array_join(F.transform(hashes, lambda h: F.left(h, F.lit(8))), "-").alias("branch"))

    def section(s: Column) -> Column:
        parts = F.transform(F.split(s, "\n", -1), paragraph)
        return F.transform(F.array(parts), lambda x: F.struct(F.sha2(F.array_join(x["digest"], "").cast("binary"), 256).alias("digest"), F.array_join(x["branch"], ",").alias("branch")))[0]

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n(?=\n)", -1), section)


def fingerprint(text: Column) -> Column:
    """The printed fingerprint of a text."""
    return F.transform(F.array(tree(text)), lambda t: F.concat(F.left(F.sha2(F.array_join(t["digest"], "").cast("binary"), 256), F.lit(32)), F.lit(":"), F.array_join(t["branch"], ";")))[0]


def leaves(print_: Column) -> Column:
    """The distinct leaves of a printed fingerprint."""
    return F.array_distinct(F.filter(F.split(F.substring_index(print_, ":", -1), "[;,-]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints' leaves; 1 if they are equal."""
    return F.when(a == b, F.lit(1.0)).otherwise(_shared(leaves(a), leaves(b)))


def _shared(x: Column, y: Column) -> Column:
    def of(p: Column) -> Column:
        both, total = F.size(F.array_intersect(p["x"], p["y"])), F.size(p["x"]) + F.size(p["y"])
        return F.when(total > 0, both.cast("double") / F.greatest(total - both, F.lit(1))).otherwise(F.lit(0.0))

    return F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), of)[0]


def differing(a: Column, b: Column) -> Column:
    """Places (section, from 0) at which two fingerprints' branches differ; empty if the roots agree."""
    cut = lambda p: F.split(F.substring_index(p, ":", -1), ";")
    pairs = F.arrays_zip(cut(a).alias("x"), cut(b).alias("y"))
    places = F.filter(F.transform(pairs, lambda p, i: F.when(p["x"].eqNullSafe(p["y"]), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<int>")).otherwise(places)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds a key reaches, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.coalesce(F.get(known, n + s - 1) <= key, F.lit(False)), n + s).otherwise(n))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each document beside the next in descending doc_id, the last beside the first."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    n = rows.count()
    ranges = min(RANGES, max(1, n // RANGE_DOCS))
    bounds: list[int] = []
    if ranges > 1:
        at = [k / ranges for k in range(1, ranges)]
        bounds = sorted(set(rows.agg(F.percentile_approx("key", at, max(10_000, 4 * ranges)).alias("q")).first()["q"]))
    rows = rows.withColumn("range", _range_of(F.col("key"), bounds))
    # at most one head per range, so RANGES + 1 rows; ranges that hold no row have none
    heads = [(r["range"], r["head"]) for r in rows.groupBy("range").agg(F.max("key").alias("head")).orderBy("range").collect()]
    spark = docs.sparkSession
    goes_to = [(heads[(i + 1) % len(heads)][0], head) for i, (_, head) in enumerate(heads)]
    ghosts = spark.createDataFrame(goes_to, "to int, key long")
    copies = rows.join(F.broadcast(ghosts), "key").select("doc_id", "text", "key", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    every = rows.withColumn("ghost", F.lit(False)).select("doc_id", "text", "key", "range", "ghost").unionByName(copies)
    order = Window.partitionBy("range").orderBy("ghost", F.desc("key"), "text")
    lead = F.lead(F.struct("text", "print")).over(order)
    return every.withColumn("print", fingerprint(F.col("text"))).withColumn("next", lead).where("not ghost").select("doc_id", "text", "print", F.col("next.text").alias("next_text"), F.col("next.print").alias("next_print"))


def edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The contract's columns: each document, its edited text, both fingerprints and their likeness."""
    rows = with_next(docs, text, doc_id).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("half", half).withColumn("new", F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("half")), F.left("next_text", F.col("half"))))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"), "next_print")
    return rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_print"))).drop("next_print")
