"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, names (capitalised words inside a sentence) and units after a number become typed placeholders. Windows of
WINDOW template words of documents are hash-joined with those of benchmark items; an item that is shorter is one window.
Windows with too few literal words are not looked up; an item of such windows alone is looked up by windows of its words as
they are, numbers and names included, so that short items and lists are found where they are repeated. Matches are aligned by their offset; where enough windows of an
item match at one offset, the values in the slots of the matched windows are compared: a re-parameterised copy maps each
value of the item to one value of the document. Different values of the item may become equal ones.

The lookup side is broadcast only if a count finds it small, else both sides are shuffled by hash.

Defined results: null or empty texts and items match nothing; repeated items match each by its own id; repeated
documents give repeated aligned windows, so a match stays one; empty tables give an empty table; texts of any length are
cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm._util import BROADCAST_ROWS, lookup, written

#: Template words per window; literal words it needs; windows that must match at one offset, or this share of an item's.
WINDOW, LITERALS, ENOUGH, SHARE = 8, 4, 6, 0.5
#: Words and sentence ends of a text. Digits with inner marks are one number.
TOKEN = r"[.!?]|\d+(?:[.,:/]\d+)*|[\p{L}\p{M}]+"
#: Fixed list of unit words.
UNITS = (
    "mm cm m km inch inches foot feet mile miles mg g kg ton tons pound pounds ounce ounces ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees "
    "cent cents dollar dollars euro euros kmh mph volt volts watt watts"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
#: Kind of the windows of words as they are.
PLAIN = 1000


def template(text: Column) -> Column:
    """The words of a text, each (t, v): a hash of the literal word or the placeholder's number, and the word itself."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def place(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, low = F.get(all_, i - 1), F.lower(x)
            number = lambda w: (F.substring(w, 1, 1) >= "0") & (F.substring(w, 1, 1) <= "9")
            name = (low != x) & (i > 0) & (F.substring(low, 2, 1 << 30) == F.substring(x, 2, 1 << 30)) & ~before.isin(".", "!", "?")
            t = F.when(number(x), F.lit(NUMBER)).when(name, F.lit(NAME)).when(low.isin(UNITS) & F.coalesce(number(before), F.lit(False)), F.lit(UNIT)).otherwise(F.xxhash64(low))
            return F.struct(t.cast("bigint").alias("t"), x.alias("v"))

        return F.filter(F.transform(all_, one), lambda w: ~w["v"].isin(".", "!", "?"))

    return F.transform(F.array(found), place)[0]


def _word(x: Column) -> Column:
    """A template word as it stands in the text."""
    return F.xxhash64(F.lower(x["v"]))


def windows(t: Column, width: int, kind: int = 0) -> Column:
    """(at, h) of each run of `width` template words; windows of different kinds never match."""
    last = F.size(t) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(width + kind), *[F.get(t, i + k) for k in range(width)]).alias("h")))


def _literal(t: Column) -> Column:
    return F.size(F.filter(t, lambda x: ~x.isin(NUMBER, NAME, UNIT)))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, n_slots, same_values) of each leaked item of each document."""
    bench = benchmark.select(F.col(item_id).alias("item_id"), template(F.col(item_text)).alias("w")).withColumn("t", F.col("w.t")).where(F.size("t") > 0)
    bench = written(bench.select("item_id", "w", "t", F.least(F.size("t"), F.lit(WINDOW)).alias("width")), "bench-templates")
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())  # WINDOW values at most
    if not widths:
        widths = [WINDOW]
    cut = None
    for w in widths:
        cut = F.when(F.col("width") == w, windows(F.col("t"), w)) if cut is None else cut.when(F.col("width") == w, windows(F.col("t"), w))
    keys = bench.select("item_id", "width", "t", F.explode(cut).alias("k")).where(_literal(F.slice("t", F.col("k.at") + 1, F.col("width"))) >= F.least(F.col("width"), F.lit(LITERALS)))
    keys = written(keys.select("item_id", F.col("k.at").alias("item_at"), F.col("k.h").alias("h")), "bench-windows")
    # items of which no window has enough literal words are looked up with their numbers and names as they are
    plain = bench.join(keys.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "width", F.transform("w", _word).alias("r"))
    plain = written(plain, "bench-plain")
    plain_widths = sorted(r["width"] for r in plain.select("width").distinct().collect())  # WINDOW values at most
    if plain_widths:
        cut = None
        for w in plain_widths:
            one = windows(F.col("r"), w, PLAIN)
            cut = F.when(F.col("width") == w, one) if cut is None else cut.when(F.col("width") == w, one)
        more = plain.select("item_id", F.explode(cut).alias("k")).select("item_id", F.col("k.at").alias("item_at"), F.col("k.h").alias("h"))
        keys = written(keys.union(more), "bench-windows")
    per_item = keys.groupBy("item_id").agg(F.countDistinct("item_at").alias("item_windows"))

    rows = docs.select(F.col(doc_id).alias("doc_id"), template(F.col(text)).alias("w"))
    words = [F.transform("w", lambda x: x["t"]).alias("t")] + ([F.transform("w", _word).alias("r")] if plain_widths else [])
    cuts = [windows(F.col("t"), w) for w in widths] + [windows(F.col("r"), w, PLAIN) for w in plain_widths]
    each = rows.select("doc_id", *words).select("doc_id", F.explode(F.concat(*cuts)).alias("k")).select("doc_id", F.col("k.at").alias("at"), F.col("k.h").alias("h"))
    small = keys.count() <= BROADCAST_ROWS
    hits = each.join(F.broadcast(keys) if small else keys, "h")
    aligned = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("ats"))
    aligned = aligned.withColumn("n_windows", F.size("ats").cast("long"))
    enough = lookup(aligned, per_item, ["item_id"], "inner").where(F.col("n_windows") >= F.least(F.lit(ENOUGH), F.ceil(F.col("item_windows") * SHARE)))
    enough = written(enough, "bench-hits")

    texts = lookup(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), enough.select(F.col("doc_id")).distinct(), ["doc_id"], "left_semi")
    full = texts.dropDuplicates().withColumn("dw", template(F.col("text"))).select("doc_id", "dw")
    slots = enough.join(full, "doc_id").join(bench.select("item_id", "w", "width"), "item_id")

    def pair(x: Column, i: Column) -> Column:
        met = F.when(i + F.col("shift") >= 0, F.get(F.col("dw"), (i + F.col("shift")).cast("int")))
        matched = F.exists("ats", lambda at: (at <= i) & (i < at + F.col("width")))
        return F.struct(x["t"].alias("t"), F.lower(x["v"]).alias("item"), F.when(matched & (met["t"] == x["t"]), F.lower(met["v"])).alias("doc"))

    pairs = F.filter(F.transform("w", pair), lambda p: p["t"].isin(NUMBER, NAME, UNIT) & p["doc"].isNotNull())
    judged = slots.withColumn("p", F.array_distinct(pairs)).withColumn("n_slots", F.size("p"))
    one = lambda name: F.size(F.array_distinct(F.transform("p", lambda x: F.struct(x["t"], x[name])))) == F.col("n_slots")
    kept = judged.where(one("item")).withColumn("same_values", F.forall("p", lambda x: x["item"] == x["doc"]))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_windows"), "shift")
    return (
        kept.select("doc_id", "item_id", "shift", "n_windows", "item_windows", "n_slots", "same_values")
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select("doc_id", "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "n_slots", "same_values")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """docs without the documents into which an item leaked. Rows without an id can't be named and stay."""
    name = columns.get("doc_id", "doc_id")
    found = leaks(docs, benchmark, **columns).select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    found = written(found, "bench-leaked")
    return lookup(docs, found, [name], "left_anti")
