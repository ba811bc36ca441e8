"""What surrounds a download: which files are wanted, the call itself as a hook, and what is stored.

The network is not reached from here: `get` is any function from a url to a text, shipped to the workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_CALL = 500
# fixed value: the line between prepared remarks and questions
BOUNDARY = "\n\nQuestions and Answers:\n\n"


def wanted(listing: DataFrame, have: DataFrame, years: int = 3) -> DataFrame:
    """Of a listing (ticker, form, date) the newest of each ticker and form, one a year for 10-K and four for others, without those we have (name)."""
    newest = Window.partitionBy("ticker", "form").orderBy(F.desc("date"))
    most = F.when(F.col("form") == "10-K", years).otherwise(4 * years)
    named = listing.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most).drop("place")
    named = named.withColumn("name", F.concat(F.concat_ws("_", "ticker", "form", F.col("date").cast("string")), F.lit(".txt")))
    return named.join(have.select("name"), "name", "left_anti")


def fetched(requests: DataFrame, get: Callable[[str], str | None], key: str = "name", url: str = "url") -> DataFrame:
    """(key, raw, error) of requests (key, url): what `get` returns, or why it failed. One call a row, in as many tasks as there are partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, errors = [], []
            for at in batch.column(1).to_pylist():
                try:
                    raw, error = get(at), None
                except Exception as e:  # whatever a download may raise: the row says so, the others go on
                    raw, error = None, f"{type(e).__name__}: {e}"
                raws.append(raw)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.string()), pa.array(errors, pa.string())], names=[key, "raw", "error"])

    rows = requests.select(F.col(key).cast("string").alias(key), F.col(url).cast("string").alias(url))
    return rows.mapInArrow(run, f"{key} string, raw string, error string")


def stitched(remarks: Column, questions: Column, whole: Column) -> Column:
    """A call's text: remarks and questions with a boundary line where both are there, else the whole; null if it is too short to keep."""
    parts = F.concat(F.trim(remarks), F.lit(BOUNDARY), F.trim(questions))
    text = F.when((F.length(remarks) > 0) & (F.length(questions) > 0), parts).otherwise(F.coalesce(whole, F.lit("")))
    return F.when(F.length(text) >= LEAST_CALL, text)


def content_type(name: Column, raw: Column) -> Column:
    """What a file is stored as, by its start; null for files that aren't stored."""
    head = F.substring(raw, 1, 5000)
    kind = F.when(F.contains(head, F.lit("</")) | F.contains(F.lower(head), F.lit("<html")), "text/html; charset=utf-8").otherwise("text/plain; charset=utf-8")
    return F.when(F.lower(name).rlike(r"\.(txt|html?)$"), kind)
