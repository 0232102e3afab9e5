"""The corpus pipeline: five stages from the documents table to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; each works on whatever its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm import decontaminate, langid, mixing, near_dup, token_files
from talentlake.llm._util import configured, new_path, written
from talentlake.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents have, with missing labels filled by prediction. Texts
    without a letter go, and those whose code under every language is longer than their plain bytes. Without a labelled
    document nothing is judged and all stay; null and empty texts have no letter and go."""
    configured(spark)
    model = langid.train(docs)
    if not model.langs:
        return docs
    judged = langid.identify(docs, model)
    lang = F.coalesce(F.col("lang"), F.col("lang_pred")).alias("lang")
    return judged.where(~langid.foreign(judged)).select(*[lang if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; documents without words or id stay."""
    configured(spark)
    return near_dup.dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; null and empty texts match nothing and stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are taken no times."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32. A null text has its end id alone."""
    configured(spark)
    path = new_path(spark, "token-files")
    token_files.encode(docs, path, vocabulary())
    return token_files.decode(spark, path)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: SQL expresses neither the language model nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
