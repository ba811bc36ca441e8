"""Incremental ingestion with Structured Streaming: an extension, the batch readers do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import clean
from quarry.sources.corpus import decoded, parse_name


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as cleaned documents."""
    raw = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.{txt,htm,html}").option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = parse_name(raw.withColumn("name", F.element_at(F.split("path", "/"), -1)))
    return named.select("doc_id", "ticker", "form", "date", "modificationTime", clean(decoded(F.col("content"))).alias("text"))


def append_new(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each document once: exact duplicates of an id within a batch go, and ids already stored are left out."""

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["doc_id"])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(target).select("doc_id"), "doc_id", "left_anti")
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and mean values by type and window; late rows beyond the watermark are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
