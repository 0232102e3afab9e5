"""Secret scan by corpus-wide ownership frequency, in DataFrame functions alone.

Base patterns and a wider pattern of key-like strings give candidate spans. Hashes of their values are aggregated by
distinct repositories and owners: a value of one owner in few repositories looks live; one that many hold is a copied
example. Live values of the wider pattern are added as spans; base spans stay whatever their verdict.

Positions come from splitting a text at the matches and adding up lengths (code points, end exclusive). The corpus-wide
part sees no text. A value that very many rows share is taken out, before rows are joined by value, by a broadcast list
of the HEAVY most frequent copied values, so that no join key holds more than 1/HEAVY of the rows.

Defined results: a null text counts as empty; no match gives zero counts and an empty string; a null owner or repository
is one owner or repository; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import written

#: Fixed values of the contract: kinds in order, patterns, least lengths (of group 2 for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Key-like strings that the method may add: long, with letters and digits, many different characters.
KEYLIKE, KEYLIKE_LEAST, KEYLIKE_KINDS = r"[A-Za-z0-9+/_=-]{20,}", 20, 10
ADDED = "live"
#: A value looks live if this many owners and repositories hold it at most.
MOST_OWNERS, MOST_REPOS = 1, 3
#: Length of the list of most frequent copied values.
HEAVY = 1000

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,h:bigint>>"


def _spans(text: Column, may: str, pattern: str, kind: int, value, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that keep() accepts; `may` finds texts that can have one."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.struct(g.alias("gap"), F.length(m).cast("bigint").alias("n")))
    ends = F.aggregate(steps, F.array(F.lit(0).cast("bigint")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["gap"] + s["n"])))
    found = F.transform(
        F.arrays_zip(hits.alias("m"), F.slice(ends, F.lit(2), F.size(hits)).alias("e")),
        lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), F.xxhash64(value(x["m"])).alias("h"), keep(x["m"]).alias("ok")),
    )
    kept = F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["kind"], x["end"], x["h"]))
    return F.when(text.rlike(may), kept).otherwise(F.array()).cast(_SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of a text: (start, kind, end, hash of the value); kind is a place in KINDS, or 3 for key-like."""
    text = F.coalesce(text, F.lit(""))
    second = lambda m: F.regexp_extract(m, ASSIGN, 2)
    base = F.concat(
        _spans(text, ASSIGN, ASSIGN, 0, second, lambda m: F.length(second(m)) >= 8),
        _spans(text, ACCESS + "{1}", ACCESS, 1, lambda m: m, lambda m: F.length(m) >= 16),
        _spans(text, "[0-9a-f]{32}", "[0-9a-f]{32,}", 2, lambda m: m, lambda m: F.lit(True)),  # a run of fewer is no match
    )
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= KEYLIKE_KINDS)
    wide = _spans(text, KEYLIKE, KEYLIKE, len(KINDS), lambda m: m, mixed)
    return F.transform(F.array(base, wide), lambda x: x)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and findings, an array of (start, kind name, end, live) by start, then kind.

    Base findings always stay; key-like ones only where their value looks live and they overlap no base finding."""
    clash = lambda base: lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), candidates(F.col(text)).alias("c"))
    spans = F.concat(F.col("c")[0], F.filter(F.col("c")[1], clash(F.col("c")[0])))
    narrow = written(raw.select("doc_id", "owner", "repo", spans.alias("spans"), F.monotonically_increasing_id().alias("rid")), "secret-spans")
    each = narrow.select("rid", "owner", "repo", F.explode("spans").alias("s")).select("rid", "owner", "repo", "s.*")
    by_owner = each.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
    held = written(by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")), "secret-values")
    is_live = (F.col("owners") <= MOST_OWNERS) & (F.col("repos") <= MOST_REPOS)
    heavy = held.where(~is_live).orderBy(F.desc("repos"), "h").limit(HEAVY).select("h")
    light = each.join(F.broadcast(heavy), "h", "left_anti")
    live = light.join(held.where(is_live).select("h"), "h", "left_semi")
    by_row = live.groupBy("rid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("live"))
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    lives = F.coalesce(F.col("live"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    judged = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"], F.array_contains(lives, F.struct(s["start"], s["kind"], s["end"])).alias("live")))
    kept = F.array_sort(F.filter(judged, lambda s: (s["kind"] < len(KINDS)) | s["live"]))
    named = F.transform(kept, lambda s: F.struct(s["start"], F.element_at(names, s["kind"] + 1).alias("kind"), s["end"], s["live"]))
    return narrow.join(by_row, "rid", "left").select("doc_id", named.alias("findings"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(findings: DataFrame) -> DataFrame:
    """The contract's columns of scan()'s result, and how many findings look live or copied."""
    base = F.filter("findings", lambda s: s["kind"] != ADDED)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("findings", test)).cast("long")
    return findings.select(
        "doc_id",
        *[count(_is(k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )
