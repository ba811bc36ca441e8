"""A stored calendar of prices: bucketed by ticker, extended by dates without rewriting, read without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.returns import WINDOWS
from quarry.operators.storage import Manifest

BUCKETS, MERGE, BLOCK = 64, 16, 64


class PriceCalendar:
    """Prices (key, date, close) in one table of the warehouse, bucketed by key and sorted by key and date in each bucket's files.

    Batches of dates are added as files of the same buckets, under a name of their own; a manifest under `root` tells which table and batches count, so
    a writer that dies before its commit has changed nothing, and of two writers both batches count. Of several prices of a key's
    day the one of the latest batch counts, within a batch the greatest. Rows without key, date or close are left out. Choosing among batches, leads and
    the as-of step stay within a bucket: prices are in no exchange.
    """

    def __init__(self, spark: SparkSession, name: str, root: str, key: str = "ticker", buckets: int = BUCKETS):
        self.spark, self.name, self.key = spark, name, key
        self.manifest = Manifest(spark, root)
        self.buckets = self.manifest.read().get("buckets", buckets)

    def batches(self) -> list[str]:
        """The batches that count, oldest first."""
        return self.manifest.read().get("batches", [])

    def _write(self, prices: DataFrame, table: str) -> str:
        batch = uuid.uuid4().hex
        rows = prices.select(self.key, F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"))
        rows = rows.where(F.col(self.key).isNotNull() & F.col("date").isNotNull() & F.col("close").isNotNull())
        rows = rows.groupBy(self.key, "date").agg(F.max("close").alias("close")).withColumn("batch", F.lit(batch))
        dealt = rows.repartition(self.buckets, self.key)  # as buckets are dealt, so a batch adds one file a bucket
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, self.key).sortBy(self.key, "date").saveAsTable(table)
        return batch

    def append(self, prices: DataFrame) -> str:
        """Store a batch and make it count; its name. Many batches are merged by `compact`. Where that went on meanwhile, the batch is written to the new table."""
        while True:
            table = self.manifest.read().get("table") or f"{self.name}_{uuid.uuid4().hex}"
            batch = self._write(prices, table)
            taken = []

            def edit(content: dict) -> dict:
                taken[:] = [content.get("table", table) == table]
                return {"buckets": self.buckets, "table": table, "batches": [*content.get("batches", []), batch]} if taken[0] else content

            self.manifest.change(edit)
            if taken[0]:
                return batch

    def compact(self, least: int = MERGE) -> bool:
        """Rewrite the table as one batch if it has `least` or more. Where a batch came meanwhile nothing changes. The former table stays for its readers, until `vacuum`."""
        base = self.manifest.read()
        if len(base.get("batches", [])) < least:
            return False
        table = f"{self.name}_{uuid.uuid4().hex}"
        merged = {"buckets": self.buckets, "table": table, "batches": [self._write(self.read(), table)]}
        done = []

        def edit(content: dict) -> dict:
            done[:] = [content == base]
            return merged if done[0] else content

        self.manifest.change(edit)
        return done[0]

    def vacuum(self) -> list[str]:
        """Drop this calendar's tables that don't count. For times without other writers and without readers of former versions."""
        now = self.manifest.read().get("table")
        gone = sorted(t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name}_") and t.name != now)
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return gone

    def read(self) -> DataFrame:
        """(key, date, close) as they count now, dealt by key in the stored buckets."""
        content = self.manifest.read()
        if not content.get("batches"):
            return self.spark.createDataFrame([], f"{self.key} string, date date, close double")
        names = content["batches"]
        place = F.array_position(F.array(*map(F.lit, names)), F.col("batch"))
        stored = self.spark.table(content["table"]).where(F.col("batch").isin(names))
        return stored.groupBy(self.key, "date").agg(F.max(F.struct(place.alias("place"), "close")).alias("m")).select(self.key, "date", F.col("m.close").alias("close"))

    def forward(self, events: DataFrame, windows=WINDOWS) -> DataFrame:
        """(events' columns, window, ret) of events (key, date, ...), as `returns.forward` gives them.

        A key's prices lie in blocks of BLOCK days, each for the event days from the price before it up to its last one. Distinct event days are dealt by
        key as the buckets are and meet the one block they fall in; a day takes the block's first price strictly after it. Only days of events and their
        returns are exchanged; a key with many events is no larger a group than its days.
        """
        key = self.key
        order = Window.partitionBy(key).orderBy("date")
        ahead = F.array(*[F.struct(F.lit(w).alias("window"), (F.lead("close", w).over(order) / F.col("close") - 1).alias("ret")) for w in windows])
        laid = self.read().select(key, F.struct("date", ahead.alias("ahead")).alias("row"), F.lag("date").over(order).alias("before"), F.expr(f"(row_number() OVER (PARTITION BY {key} ORDER BY date) - 1) div {BLOCK}").alias("block"))
        blocks = laid.groupBy(F.col(key).alias("_key"), "block").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.min_by("before", "row.date").alias("since"), F.max("row.date").alias("until"))
        days = events.select(key, F.col("date").cast("date").alias("date")).distinct().repartition(self.buckets, key)
        inside = (F.col(key) == F.col("_key")) & (F.col("since").isNull() | (F.col("date") >= F.col("since"))) & (F.col("date") < F.col("until"))
        first = F.get(F.filter("rows", lambda r: r["date"] > F.col("date")), F.lit(0))
        found = days.join(blocks.hint("merge"), inside).select("_key", F.col("date").alias("_date"), first["ahead"].alias("ahead"))
        met = events.join(found, (F.col(key) == F.col("_key")) & (F.col("date").cast("date") == F.col("_date")))
        return met.select(*events.columns, F.inline("ahead")).where("ret is not null")
