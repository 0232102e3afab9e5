"""Forms, tokens, artifacts and provenance: checks that report all violations as rows or arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.text import strip

LANGUAGES = ("auto", "vi", "en")
JD_CHARS = (80, 30_000)


def form_errors(consent: Column, file_name: Column, jd: Column, language: Column) -> Column:
    """All errors of an upload form, in order."""
    n = F.length(strip(F.coalesce(jd, F.lit(""))))
    name = F.coalesce(file_name, F.lit(""))
    return F.array_compact(F.array(
        F.when(~F.coalesce(consent, F.lit(False)), F.lit("consent")),
        F.when(name == "", F.lit("file")).when(~F.lower(name).endswith(".pdf"), F.lit("file_type")),
        F.when(n < JD_CHARS[0], F.lit("jd_short")).when(n > JD_CHARS[1], F.lit("jd_long")),
        F.when(~F.coalesce(language.isin(*LANGUAGES), F.lit(False)), F.lit("language")),
    ))


def is_job_token(token: Column) -> Column:
    return token.rlike("^[0-9a-f]{48}$")


def is_remote_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]+$")


def is_safe_path(path: Column) -> Column:
    """Relative, and without a step upwards."""
    return ~path.startswith("/") & ~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


def provenance(rows: DataFrame, expected: dict, count: int | None = None, key: str = "sample_id") -> DataFrame:
    """(rule, n): constraints that rows break. expected: column to value; keys must be distinct, rows `count` if given."""
    one = rows.agg(
        *[F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"differs:{c}") for c, v in expected.items()],
        (F.count(key) - F.countDistinct(key)).alias("repeated_key"), F.count_if(F.col(key).isNull()).alias("missing_key"),
        *([(F.abs(F.count(F.lit(1)) - count)).alias("count")] if count is not None else []),
    )
    names = one.columns
    return one.select(F.stack(F.lit(len(names)), *[x for c in names for x in (F.lit(c), F.col(c).cast("long"))]).alias("rule", "n")).where("n > 0")


def outside_split(rows: DataFrame, split: str = "validation", column: str = "split") -> DataFrame:
    """Rows of another split, a missing one included."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(split)))


def manifest_differences(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, problem): missing and extra files, and sizes or hashes that differ. Both: name, size, sha256."""
    f, m = files.select("name", F.col("size").alias("fs"), F.col("sha256").alias("fh")), manifest.select("name", F.col("size").alias("ms"), F.col("sha256").alias("mh"))
    both = f.join(m, "name", "full_outer")
    problem = F.when(F.col("ms").isNull() & F.col("mh").isNull(), "extra").when(F.col("fs").isNull() & F.col("fh").isNull(), "missing").when(~F.col("fs").eqNullSafe(F.col("ms")), "size").when(~F.col("fh").eqNullSafe(F.col("mh")), "sha256")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted, with side a or b; empty if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
