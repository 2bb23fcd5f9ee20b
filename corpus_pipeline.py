"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import language, minhash, packing, secret_scan
from knotwork.llm.common import rows_per_batch, table, written
from knotwork.llm.minhash import TEXTS
from knotwork.llm.queries import END, RANK_FILE


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no learned language go, missing labels are filled; the
    classifier learns from the documents at hand."""
    return language.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document of least id stays."""
    return minhash.without_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redacted(docs, rank_file=RANK_FILE)


def in_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: bins of the tokens of whole documents, or of pieces of long ones."""
    return packing.packed_texts(docs, RANK_FILE, public_tokenizers.PATTERN, END)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", in_a_language),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("packing", in_bins),
]

#: Neither the classifier nor the packing can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with rows_per_batch(spark, TEXTS):
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
