"""Reading the tables the queries are bound to, and the index of a table's texts, which outlives one query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.answering import Index, build_index
from quarry.operators.calendar import PriceCalendar
from quarry.operators.storage import fingerprint, shared_dir
from quarry.operators.vector_index import VectorIndex

#: functions.text.letter_vector in DuckDB.
LETTERS_SQL = "(SELECT [x / greatest(sqrt(list_sum([y * y FOR y IN v])), 1e-6) FOR x IN v] FROM (SELECT [x - list_sum(c) / 26 FOR x IN c] AS v FROM (SELECT [(length(lower({0})) - length(replace(lower({0}), l, '')))::DOUBLE FOR l IN string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')] AS c)))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a table's index: the same as long as the application runs and the table's files stay."""
    held = spark.sparkContext.__dict__.setdefault("_quarry_indexes", {})
    return held.setdefault(fingerprint(spark, f"{sf_dir}/{name}.parquet"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


def indexed(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents: built at its first use, found again afterwards."""
    return build_index(table(spark, sf_dir, "documents"), root=_root(spark, sf_dir, "documents"), keep=("lang",))[0]


def vector_indexed(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The approximate index of the vectors, likewise."""
    index = VectorIndex(spark, _root(spark, sf_dir, "embeddings"))
    if not index.manifest.version():
        index.build(table(spark, sf_dir, "embeddings"), "label")
    return index


def calendared(spark: SparkSession, sf_dir: str, prices: DataFrame) -> PriceCalendar:
    """The stored calendar of prices that are made from events, likewise; the later half of the dates arrives as a second batch."""
    root = _root(spark, sf_dir, "events") + "-prices"
    calendar = PriceCalendar(spark, f"prices_{root.split('index-')[-1].replace('-', '_')}", root)
    if len(calendar.batches()) < 2:  # a build that broke off is made again: of equal days the latest batch counts
        half = F.lit(prices.agg(F.expr("date_add(min(date), cast(datediff(max(date), min(date)) div 2 as int))")).first()[0]).cast("date")
        for part in (prices.where(F.col("date") <= half), prices.where(F.col("date") > half)):
            calendar.append(part)
    return calendar
