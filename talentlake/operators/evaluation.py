"""Evaluation of predictions against gold records: items, spans, flags, issues and efficiency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from talentlake.functions.text import value
from talentlake.operators.jsonc import once
from talentlake.operators.pointer import span_slots
from talentlake.session import new_path

LIST_FIELDS = {"experience": ("company", "job_title", "duration", "description"), "projects": ("name", "role", "details"), "education": ("university", "degree", "gpa", "year_graduated")}
LONG_TEXT = ("summary", "experience.description", "projects.details")


def field_values(cv: Column) -> Column:
    """All values of a record as (field, raw), raw being text; 19 fields."""
    pack = lambda field, items: F.transform(items, lambda x: F.struct(F.lit(field).alias("field"), x.cast("string").alias("raw")))
    parts = [
        pack("personal_info.github_url", F.array(cv["personal_info"]["github_url"])), pack("summary", F.array(cv["summary"])),
        pack("skills.hard_skills", cv["skills"]["hard_skills"]), pack("skills.soft_skills", cv["skills"]["soft_skills"]),
        *[pack(f"{part}.{name}", cv[part][name]) for part, names in LIST_FIELDS.items() for name in names],
        pack("projects.technologies", F.flatten(cv["projects"]["technologies"])), *[pack(k, cv[k]) for k in ("certifications", "activities", "awards")],
    ]
    return F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<struct<field:string,raw:string>>")) for p in parts]), lambda x: x["raw"].isNotNull())


def items(records: DataFrame, key: str, cv: str, norm=value) -> DataFrame:
    """(key, field, item): the distinct normalised values of each record's fields."""
    rows = records.select(key, F.explode(field_values(F.col(cv))).alias("v")).select(key, F.col("v.field").alias("field"), norm(F.col("v.raw")).alias("item"))
    return rows.where("item != ''").distinct()


def compared(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """keys of either side, each once, with in_gold and in_pred. Rows may be repeated; such with a null key equal none of the
    other side.

    Both sides are dealt out by their keys before they are grouped: no task that reads holds a table of its keys, and
    nothing is sorted for a join."""
    named = lambda rows, side: rows.select(*keys, F.lit(side).alias("in_gold"), F.lit(not side).alias("in_pred"))
    parts = int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't merged into few large ones
    both = named(gold, True).unionByName(named(predicted, False)).repartition(parts, *keys)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    met = both.groupBy(*keys, F.when(~whole, F.col("in_gold")).alias("side_")).agg(F.bool_or("in_gold").alias("in_gold"), F.bool_or("in_pred").alias("in_pred"))
    return met.drop("side_")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp and fn by group."""
    n = lambda test: F.count_if(test)
    return rows.groupBy(*by).agg(n(F.col("in_gold") & F.col("in_pred")).alias("tp"), n(~F.col("in_gold")).alias("fp"), n(~F.col("in_pred")).alias("fn"))


def scored(rows: DataFrame) -> DataFrame:
    """rows of tp, fp and fn with support, precision, recall and f1: null where nothing was seen, else 0 for an empty denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    seen = tp + fp + fn > 0
    share = lambda a, b: F.when(seen, F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    out = rows.withColumn("support", tp + fn).withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(F.when(seen, F.lit(0.0))))


def micro_macro(by_field: DataFrame) -> DataFrame:
    """One row over all fields: micro scores, and the mean f1 of fields that gold supports."""
    total = by_field.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")],
        F.avg(F.when((F.col("support") > 0) & F.col("f1").isNotNull(), F.col("f1"))).alias("macro_f1"),
        F.count_if((F.col("support") > 0) & F.col("f1").isNotNull()).alias("supported_fields"),
        F.array_sort(F.collect_set(F.when(F.col("support") == 0, F.col("field")))).alias("zero_support_fields"),
        F.array_sort(F.collect_set(F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, F.col("field")))).alias("no_item_fields"),
    )
    return scored(total)


def mismatches(rows: DataFrame, key: str) -> DataFrame:
    """(key, field, extra, missing) of every field whose sets differ, values sorted."""
    part = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("item"))))
    # fields whose items all agree have no row here
    out = rows.where(F.col("in_gold") != F.col("in_pred")).groupBy(key, "field").agg(part(~F.col("in_gold")).alias("extra"), part(~F.col("in_pred")).alias("missing"))
    return out.where((F.size("extra") > 0) | (F.size("missing") > 0))


def span_pairs(samples: DataFrame, key: str, gold: str, predicted: str) -> DataFrame:
    """(key, path, kind, gold, pred, found) of every gold place for a span; found is false where the prediction lacks it."""
    slots = lambda col, name: samples.select(key, F.explode(span_slots(F.col(col))).alias("s")).select(key, "s.path", "s.kind", F.col("s.span").alias(name))
    pred = slots(predicted, "pred").drop("kind").withColumn("found", F.lit(True))
    return slots(gold, "gold").join(pred, [key, "path"], "left").fillna(False, ["found"])


def span_accuracy(pairs: DataFrame) -> DataFrame:
    """Exactness of spans over all and by kind (kind null: all); null accuracies for empty denominators."""
    exact = F.col("found") & F.col("gold").eqNullSafe(F.col("pred"))
    cited = F.col("gold").isNotNull()
    out = pairs.rollup("kind").agg(
        F.count(F.lit(1)).alias("all_slots"), F.count_if(exact).alias("all_exact"), F.count_if(cited).alias("non_null_gold"), F.count_if(cited & exact).alias("non_null_exact")
    )
    return out.withColumn("all_slots_accuracy", F.try_divide("all_exact", "all_slots")).withColumn("non_null_gold_accuracy", F.try_divide("non_null_exact", "non_null_gold"))


# -- whole records ------------------------------------------------------------------------------------------------------

#: What a missing place shows in a list of errors (fixed value).
MISSING = "__MISSING__"


def leaves(value: Column, kind: DataType, path: Column | None = None) -> Column:
    """All places of a nested value as (path, value): fields by name, items by number, a list's length as `path[]`; the value
    is text, null where there is none. A null struct or list is a place of its own."""
    name = lambda part: F.lit(part) if path is None else F.concat(path, F.lit("." + part))
    at = F.lit("$") if path is None else path
    leaf = lambda where, text: F.array(F.struct(where.alias("path"), text.cast("string").alias("value")))
    if isinstance(kind, StructType):
        inside = F.concat(*[leaves(value[f.name], f.dataType, name(f.name)) for f in kind.fields])
        return F.when(value.isNull(), leaf(at, F.lit(None))).otherwise(inside)
    if isinstance(kind, ArrayType):
        each = F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(value.isNull(), leaf(at, F.lit(None))).otherwise(F.concat(leaf(F.concat(at, F.lit("[]")), F.size(value)), each))
    return leaf(at, value)


def differences(expected: Column, actual: Column) -> Column:
    """(path, expected, actual) of the places of two arrays of leaves that differ, by path; a place that only one has shows
    MISSING for the other. Null equals null alone."""
    by = lambda side: F.map_from_entries(side)
    other = lambda m, k: F.when(F.map_contains_key(m, k), F.element_at(m, k)).otherwise(F.lit(MISSING))

    def apart(m: Column) -> Column:
        paths = F.array_sort(F.array_union(F.map_keys(m["e"]), F.map_keys(m["a"])))
        every = F.transform(paths, lambda k: F.struct(k.alias("path"), other(m["e"], k).alias("expected"), other(m["a"], k).alias("actual")))
        return F.filter(every, lambda d: ~d["expected"].eqNullSafe(d["actual"]))

    return once(F.struct(by(expected).alias("e"), by(actual).alias("a")), apart)


def sample_errors(rows: DataFrame, key: str, gold_pointer: str, gold_cv: str, parse: str = "pointer_parse") -> DataFrame:
    """Each sample's parse (of pointer.with_pointer) against gold records: (key, status, pointer_exact, cvschema_exact,
    pointer_differences, cv_differences, span_errors, retry_targets).

    Records are compared deeply and null-safe, as typed values. A response that gave no record differs in all places."""
    pointer_kind, cv_kind = rows.schema[gold_pointer].dataType, rows.schema[gold_cv].dataType
    read = rows.select(
        key, F.col(f"{parse}.status").alias("status"), F.col(f"{parse}.retry_targets").alias("retry_targets"), F.col(gold_pointer).alias("gp"), F.col(gold_cv).alias("gc"),
        F.from_json(F.col(f"{parse}.parsed_json"), pointer_kind).alias("pp"), F.from_json(F.col(f"{parse}.cv_json"), cv_kind).alias("pc"),
    )
    none = F.array().cast("array<struct<path:string,value:string>>")
    same = F.array().cast("array<struct<path:string,expected:string,actual:string>>")
    exact = read.withColumns({f"{x}_exact": F.col(p).eqNullSafe(F.col(g)) for x, p, g in (("pointer", "pp", "gp"), ("cvschema", "pc", "gc"))})

    def apart(x: str, gold: str, predicted: str, kind: DataType) -> Column:
        """Places are listed only for records that aren't the same."""
        of = lambda c: F.when(F.col(c).isNotNull(), leaves(F.col(c), kind)).otherwise(none)
        return F.when(F.col(f"{x}_exact"), same).otherwise(differences(of(gold), of(predicted)))

    shown = lambda side: F.transform(span_slots(F.col(side)), lambda x: F.struct(x["path"].alias("path"), F.to_json(x["span"]).alias("value")))
    spans = F.filter(differences(shown("gp"), F.coalesce(shown("pp"), none)), lambda d: ~F.coalesce(d["expected"] == MISSING, F.lit(False)))
    return exact.select(
        key, "status", "pointer_exact", "cvschema_exact", apart("pointer", "gp", "pp", pointer_kind).alias("pointer_differences"), apart("cvschema", "gc", "pc", cv_kind).alias("cv_differences"),
        F.when(F.col("pointer_exact"), same).otherwise(spans).alias("span_errors"), "retry_targets",
    )


def flag_rates(rows: DataFrame, *flags: str) -> DataFrame:
    """(flag, n, rate) of boolean columns."""
    one = rows.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return one.select("all", F.stack(F.lit(len(flags)), *[x for f in flags for x in (F.lit(f), F.col(f))]).alias("flag", "n")).select("flag", "n", F.try_divide("n", "all").alias("rate"))


def recovery_counts(rows: DataFrame, steps: str) -> DataFrame:
    """(combination, n) of recovery steps, joined by +; none for none."""
    name = F.when(F.size(steps) > 0, F.array_join(steps, "+")).otherwise("none")
    return rows.groupBy(name.alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def issue_counts(rows: DataFrame, issues: str) -> DataFrame:
    """(issue, n) by category:code."""
    each = rows.select(F.explode(issues).alias("i"))
    return each.groupBy(F.concat_ws(":", "i.category", "i.code").alias("issue")).agg(F.count(F.lit(1)).alias("n"))


#: Numbers of a group up to which its percentiles are computed at once, buckets of a histogram, and targets that are broadcast.
AT_ONCE, BUCKETS, TARGETS = 100_000, 4096, 20_000


def exact_percentiles(rows: DataFrame, number: str, probabilities: list[float], *by: str, at_once: int | None = None) -> DataFrame:
    """(*by, q): exact percentiles, linear between ranks, of each group; null where it has no number.

    Small groups, and those with infinite numbers or none-numbers, are aggregated at once. For a larger one each pass
    counts the numbers of a range by bucket and goes on with the bucket that holds a wanted rank, until that has few
    numbers or one value: no task holds a large group, however its numbers lie. What a pass finds is a row for each wanted
    rank, written to the shared folder."""
    at_once = AT_ONCE if at_once is None else at_once
    spark, names = rows.sparkSession, [f"k{i}" for i in range(len(by))]
    rows = rows.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(number).cast("double").alias("x"))
    ask = F.array(*[F.lit(float(p)) for p in probabilities])
    back = [F.col(n).alias(c) for n, c in zip(names, by, strict=True)]

    def kept(df: DataFrame) -> DataFrame:
        path = new_path(spark, "percentiles")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def on_keys(left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
        """right with other names for the keys, and the condition that keys are the same."""
        renamed = right.withColumnsRenamed({n: f"t_{n}" for n in names})
        return renamed, reduce(lambda a, n: a & F.col(n).eqNullSafe(F.col(f"t_{n}")), names, F.lit(True))

    odd = F.coalesce(F.max(F.isnan("x") | (F.abs("x") == float("inf"))), F.lit(False))
    sizes = kept(rows.groupBy(*names).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), odd.alias("odd")))
    large = sizes.where((F.col("n") > at_once) & ~F.col("odd"))
    n_large = large.count()
    if not n_large:
        return rows.groupBy(*names).agg(F.percentile("x", ask).alias("q")).select(*back, "q")
    close = F.broadcast if n_large * 2 * len(probabilities) <= TARGETS else lambda df: df
    few, same = on_keys(rows, large.select(*names))
    small = rows.join(close(few), same, "left_anti").groupBy(*names).agg(F.percentile("x", ask).alias("q"))
    if not names:  # the one group is large
        small = small.where(F.lit(False))
    # a target is a rank (from 0) and the range of numbers that it lies in, with `skip` numbers below and n within
    place = lambda p: p * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.transform(ask, lambda p: F.array(F.floor(place(p)), F.ceil(place(p))))))
    targets = kept(large.select(*names, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("skip"), "n"))
    values = []
    while True:
        one = F.col("lo") == F.col("hi")
        values.append(targets.where(one).select(*names, "rank", F.col("lo").alias("x")))
        right, same = on_keys(rows, targets.where(~one & (F.col("n") <= at_once)))
        nth = Window.partitionBy(*[f"t_{n}" for n in names], "rank").orderBy("x")
        near = rows.join(close(right), same & F.col("x").between(F.col("lo"), F.col("hi"))).withColumn("i", F.row_number().over(nth) - 1 + F.col("skip"))
        values.append(near.where(F.col("i") == F.col("rank")).select(*names, "rank", "x"))
        wide = targets.where(~one & (F.col("n") > at_once))
        if not wide.take(1):
            break
        right, same = on_keys(rows, wide.drop("n"))
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        inside = rows.join(close(right), same & F.col("x").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*names, "rank", "skip", bucket).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = Window.partitionBy(*names, "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("skip", F.col("skip") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        targets = kept(counts.where((F.col("skip") <= F.col("rank")) & (F.col("rank") < F.col("skip") + F.col("n"))).select(*names, "rank", "lo", "hi", "skip", "n"))
    found = reduce(DataFrame.unionByName, values).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("v"))  # a few ranks a group
    right, same = on_keys(found, large.select(*names, "n"))
    both = found.join(close(right), same)
    low, high = (lambda p: F.element_at("v", F.floor(place(p)))), (lambda p: F.element_at("v", F.ceil(place(p))))
    between = lambda p: F.when(F.floor(place(p)) == F.ceil(place(p)), low(p)).otherwise((F.ceil(place(p)) - place(p)) * low(p) + (place(p) - F.floor(place(p))) * high(p))
    return small.unionByName(both.select(*names, F.transform(ask, between).alias("q"))).select(*back, "q")


def efficiency(rows: DataFrame, number: str, *by: str, at_once: int | None = None) -> DataFrame:
    """Sum, mean, median and 95th percentile (linear between ranks) of a number."""
    q = exact_percentiles(rows, number, [0.5, 0.95], *by, at_once=at_once)
    out = rows.groupBy(*by).agg(F.sum(number).alias("total"), F.avg(number).alias("mean"))
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by], F.lit(True))
    return out.alias("o").join(q.alias("q"), same).select(*[F.col(f"o.{c}").alias(c) for c in by], "total", "mean", F.col("q.q")[0].alias("p50"), F.col("q.q")[1].alias("p95"))


def mean_confidence(lines: DataFrame, key: str, confidence: str) -> DataFrame:
    """(key, n_lines, mean_confidence) of read lines; lines without a confidence count but do not weigh, null if none has one."""
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.avg(confidence).alias("mean_confidence"))


def joined(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Gold beside prediction; an error at run time unless both hold the same keys, each once."""
    both = gold.withColumn("g", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), key, "full_outer")
    checked = both.withColumn("ok", F.assert_true(F.col("g").isNotNull() & F.col("p").isNotNull(), F.lit("gold and predictions differ in their keys")).isNull())
    return checked.where("ok").drop("ok", "g", "p")


def error_rows(rows: DataFrame, exact: str, issues: str) -> DataFrame:
    """Rows that are not exact or have an issue, nested columns as JSON: what the error table lists."""
    bad = rows.where(~F.col(exact) | (F.size(issues) > 0))
    return bad.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in bad.dtypes])
