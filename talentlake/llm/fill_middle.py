"""Fill-in-the-middle forms of documents, in built-in functions alone.

A text is a run of units: words of ASCII letters and single other code points. A hash of the document's id gives two cuts
between units and the form: the middle moves behind the prefix and the suffix, each part behind its sentinel, or the text
stays as it is. restored() parses the sentinels, so every form gives its text back exactly.

Every document is one row in and one row out: there is no shuffle, and an executor that is lost costs its own rows only.

Defined results: a null text counts as empty and stays plain, as do texts that hold a sentinel of their own; a null id is
hashed as the empty word; rows of equal id are cut alike, repeated rows stay; very long texts are arrays of one row;
columns of clashing names are kept, as the results are one struct; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import fresh

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Fixed values of the format: the sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are rearranged, and of those the percent that begin with the suffix.
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = "1:"


def hashed(doc_id: Column, k: int, seed: str = SEED) -> Column:
    """The k-th (from 0) group of eight hexadecimal digits of the hash of an id, as a whole number."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, seed: str = SEED, out: str = "fim") -> DataFrame:
    """docs with a struct `out`: n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output."""
    t, u, a, b, n, form, parts = fresh(docs, "fim_text", "fim_units", "fim_a", "fim_b", "fim_n", "fim_form", "fim_parts")
    whole = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    units = whole.withColumn(u, F.regexp_extract_all(t, F.lit(UNIT), 0)).withColumn(n, F.size(u))
    h = [hashed(F.col(doc_id), k, seed) for k in range(4)]
    ends = [(x % (F.col(n) + 1)).cast("int") for x in h[:2]]
    own = F.contains(F.col(t), F.lit(PREFIX)) | F.contains(F.col(t), F.lit(SUFFIX)) | F.contains(F.col(t), F.lit(MIDDLE))
    kind = F.when((F.col(t) == "") | own | (h[2] % 100 >= fim), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = units.withColumns({a: F.least(*ends), b: F.greatest(*ends), form: kind})

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(u, start, length), "")

    moved = F.col(form) != "plain"
    pieces = F.struct(
        joined(F.lit(1), F.col(a)).alias("prefix"), joined(F.col(a) + 1, F.col(b) - F.col(a)).alias("middle"), joined(F.col(b) + 1, F.col(n) - F.col(b)).alias("suffix")
    )
    split = cut.withColumn(parts, F.when(moved, pieces))
    prefix, middle, suffix = (F.col(f"{parts}.{x}") for x in ("prefix", "middle", "suffix"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm_).otherwise(F.col(t))
    result = F.struct(
        F.col(n).cast("long").alias("n"), F.col(form).alias("form"), F.length(prefix).cast("long").alias("prefix_chars"),
        F.length(middle).cast("long").alias("middle_chars"), output.alias("output"),
    )
    return split.withColumn(out, result).drop(t, u, a, b, n, form, parts)


def restored(output: Column, form: Column) -> Column:
    """The text of an output and its form: parts between sentinels, put back in order. A sentinel can't arise across the
    end of a part, as it begins with a sign that it has nowhere else."""

    def between(first: str, second: str | None) -> Column:
        begin = F.instr(output, first) + F.lit(len(first))
        if second is None:
            return F.substring(output, begin, F.length(output))
        return F.substring(output, begin, F.instr(output, second) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document, its form and the hashes of its output and of the text restored from that."""
    fim = transformed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    back = fim.withColumn("back", restored(F.col("fim.output"), F.col("fim.form")))
    return back.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2(F.col("fim.output"), 256).alias("output_sha256"), F.sha2(F.col("back"), 256).alias("restored_sha256"),
    )
