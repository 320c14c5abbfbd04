"""Corpus pipeline: quality rules, near-dedup, substring dedup, secret scans, packing.

Every stage takes all that its predecessor kept. Stages but the last return the columns of
documents: the first two drop rows, the next two change texts (and n_chars with them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photonframe.llm import packing, quality_rules, secret_scan, simhash, substring_dedup
from photonframe.llm.common import documents, materialize
from photonframe.llm.queries import tokenizer_file
from photonframe.session import ship_package

#: SQL cannot express the model, the fingerprints and the tokenizer of the stages.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and their language's perplexity bands. Null and empty
    texts have no words and go; a null language is one of its own; repeated rows share a fate."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts, the one with the least id. Null and empty
    texts are equal; of repeated rows one stays; a row without id goes where one with id stays."""
    return simhash.keep_one(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words of 13-word passages that a smaller id has are gone from the text.
    Null texts stay null; rows without id are left alone."""
    return substring_dedup.strip(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; spans of secrets have become [kind]. Null texts stay null."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens; a null text has its end id alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), keep_words=500_000)


STAGES: list[tuple[str, Stage]] = [(name, _shipped(stage)) for name, stage in (("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", substring), ("secret scans", secrets), ("packing", pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
