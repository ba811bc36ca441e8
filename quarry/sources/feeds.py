"""Company facts and prices as data sources: `spark.read.format(...)` over whatever delivers a ticker's document.

A source is made from a function that gets one ticker's document, which is shipped to the tasks. A task reads a batch of tickers; filters on the ticker are taken
over, so only those asked for are fetched. A request that fails is repeated after growing pauses; a ticker that fails for good is a row with its error, and the
others' rows stay.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quarry.operators.storage import ship

FACTS = "ticker string, tag string, fy int, fp string, form string, val double, filed string, pos int, error string"
PRICES = "ticker string, date string, close double, error string"
BATCH, TRIES, PAUSE = 50, 3, 0.5


def parse_facts(document: str) -> Iterator[tuple]:
    """(tag, fy, fp, form, val, filed, pos) of a company-facts document, of amounts in dollars."""
    pos = 0
    for tags in json.loads(document).get("facts", {}).values():
        for tag, held in tags.items():
            for fact in held.get("units", {}).get("USD", []):
                yield tag, fact.get("fy"), fact.get("fp"), fact.get("form"), None if fact.get("val") is None else float(fact["val"]), fact.get("filed"), pos
                pos += 1


def parse_prices(document: str) -> Iterator[tuple]:
    """(date, close) of lines `date,close` behind a header; lines without a close go, zones of dates are dropped."""
    for line in document.splitlines()[1:]:
        date, _, close = line.partition(",")
        if close.strip():
            yield date[:10], float(close)


class Batch(InputPartition):
    def __init__(self, tickers: list[str]):
        super().__init__(tickers)
        self.tickers = tickers


def source(name: str, schema: str, get: Callable[[str], str], parse: Callable[[str], Iterator[tuple]]) -> type[DataSource]:
    """A data source of that name; options: tickers (separated by commas), batch, tries, pause (seconds)."""
    width = len(schema.split(", ")) - 2

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.tickers = list(dict.fromkeys(t.strip() for t in options.get("tickers", "").split(",") if t.strip()))
            self.batch, self.tries, self.pause = int(options.get("batch", BATCH)), int(options.get("tries", TRIES)), float(options.get("pause", PAUSE))

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute == ("ticker",):
                    self.tickers = [t for t in self.tickers if t == f.value]
                elif isinstance(f, In) and f.attribute == ("ticker",):
                    self.tickers = [t for t in self.tickers if t in f.value]
                else:
                    yield f

        def partitions(self) -> list[Batch]:
            return [Batch(self.tickers[i : i + self.batch]) for i in range(0, len(self.tickers), self.batch)] or [Batch([])]

        def read(self, partition: Batch) -> Iterator[tuple]:
            for ticker in partition.tickers:
                try:
                    rows = list(parse(self._get(ticker)))
                except Exception as e:  # noqa: BLE001  whatever the request or the document fails with is told as a row
                    yield (ticker, *[None] * width, f"{type(e).__name__}: {e}")
                    continue
                for row in rows:
                    yield (ticker, *row, None)

        def _get(self, ticker: str) -> str:
            for turn in range(self.tries):
                try:
                    return get(ticker)
                except Exception:
                    if turn == self.tries - 1:
                        raise
                    time.sleep(self.pause * 2**turn)
            raise ValueError("tries must be 1 or more")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return Reader(self.options)

    return Source


def register(spark: SparkSession, facts: Callable[[str], str] | None = None, prices: Callable[[str], str] | None = None) -> None:
    """Make the formats `company_facts` and `prices` known to a session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for name, schema, get, parse in (("company_facts", FACTS, facts, parse_facts), ("prices", PRICES, prices, parse_prices)):
        if get:
            spark.dataSource.register(source(name, schema, get, parse))
