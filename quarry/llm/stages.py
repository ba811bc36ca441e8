"""The operators as pipeline stages: (spark, docs, sf_dir) -> the documents that go on, or the last stage's result.

Rows keep the columns of documents. Rows without a doc_id, and ids with several texts, go through every stage as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import jaccard_join as _join
from quarry.llm import language_id as _language
from quarry.llm import mixing as _mixing
from quarry.llm import packing as _packing
from quarry.llm import pii as _pii
from quarry.llm.common import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter, or no n-gram of any learned language."""
    ship(spark)
    return _language.keep_known(docs, _language.learn(_language.labelled_part(docs)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id."""
    ship(spark)
    return _join.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; all documents stay."""
    ship(spark)
    return _pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    ship(spark)
    return _mixing.materialize(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place."""
    ship(spark)
    return _packing.pack(docs)
