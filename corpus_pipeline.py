"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs. All but the last return the columns of
documents, whatever further columns those have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doccat.llm import decontaminate, langid, mixture, oddsketch, rans
from doccat.llm.common import importable, shared_path, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; the rest goes."""
    importable(spark)
    return langid.identified(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    importable(spark)
    return oddsketch.deduplicated(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    importable(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    importable(spark)
    return mixture.sampled(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document."""
    importable(spark)
    return rans.tokenised(docs)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", free_of_benchmarks),
    ("mixing sources to target weights", in_proportion),
    ("token-ID / binary output", as_tokens),
]

#: Learned models, sampling keys and tokenizers have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.split()[0].replace("/", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
