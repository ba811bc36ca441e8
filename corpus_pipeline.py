"""The corpus pipeline: every stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import stages
from quarry.llm.common import cut, table

STAGES = [
    ("language_id", stages.language_id),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("pii", stages.pii),
    ("mix_sources", stages.mix_sources),
    ("best_fit_packing", stages.best_fit_packing),
]

#: Learned language models, span decoding and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
