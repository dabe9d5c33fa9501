"""Corpus pipeline: rules, near-dedup, personal data, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns the rows that go on (all but the
last with the columns of ``documents``). ``run`` writes each stage's rows as Parquet in the shared checkpoint folder and
reads them back as the next one's input, so a lost executor costs tasks of one stage only.

SQL can express neither the signatures nor the tokenizer, so there is no ``ORACLE_SQL``; the stages are tested
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vulnsift.llm import bpe, mixing, near_dedup, pii, quality_rules
from vulnsift.llm.common import table, written
from vulnsift.llm.queries import tokenizer_path
from vulnsift.session import ship_package

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio of this very corpus."""
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, the one with the smallest id."""
    ship_package(spark)
    return near_dedup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kind and ``n_chars`` counted anew."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with calibrated chances."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that is left."""
    ship_package(spark)
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("pii", personal_data), ("mixing", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
