"""Reading a folder of documents, company facts and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import clean
from quarry.operators.fundamentals import company_facts


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse_name(files: DataFrame, name: str = "name") -> DataFrame:
    """ticker, form and date from <ticker>_<form>_<date>.<ending>; rows with other names go."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    return files.where(F.size(parts) == 3).withColumns({"ticker": parts[0], "form": parts[1], "date": parts[2], "doc_id": F.array_join(parts, "_")})


#: At most so many paths of passed-over files are sent to all tasks.
SENT = 262_144


def decoded(content: Column) -> Column:
    """Bytes as text; those that are no UTF-8 are left out. Characters that stand for unreadable ones in the file itself stay."""
    bad, mark = "\ufffd", "\ufdd0"
    safe = F.replace(F.replace(content.cast("string"), F.lit(mark), F.lit(f"{mark}a")), F.lit(bad), F.lit(f"{mark}b"))
    read = F.replace(F.make_valid_utf8(safe), F.lit(bad), F.lit(""))
    return F.replace(F.replace(read, F.lit(f"{mark}b"), F.lit(bad)), F.lit(f"{mark}a"), F.lit(mark))


def _files(spark: SparkSession, folders: list[str], *columns: str) -> DataFrame | None:
    """Columns of all documents' files and their folder's place; contents are read only if asked for."""
    out = None
    for i, folder in enumerate(folders):
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,htm,html}").load(folder)
        rows = raw.select(*columns, F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(i).alias("folder"))
        out = rows if out is None else out.unionByName(rows)
    return out


def corpus(spark: SparkSession, *folders: str) -> DataFrame:
    """(doc_id, ticker, form, date, path, text) of all .txt, .htm and .html files, cleaned; missing folders are skipped.

    Of files with the same id the first by folder, ending and path stays. That is settled from the names alone; then contents are read where they
    lie, but for those of the files passed over. Bytes that are no UTF-8 are left out.
    """
    found = [f for f in folders if _exists(spark, f)]
    listed = _files(spark, found, "path")
    if listed is None:
        return spark.sql("SELECT '' AS doc_id, '' AS ticker, '' AS form, '' AS date, '' AS path, '' AS text WHERE false")
    ending = F.when(F.endswith("name", F.lit(".txt")), 0).when(F.endswith("name", F.lit(".htm")), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("folder", ending, "path"))
    passed = parse_name(listed).withColumn("place", place).where("place > 1").select("path", "folder").persist()
    few = passed.count() <= SENT
    kept = parse_name(_files(spark, found, "path", "content")).join(F.broadcast(passed) if few else passed, ["path", "folder"], "left_anti")
    return kept.select("doc_id", "ticker", "form", "date", "path", clean(decoded(F.col("content"))).alias("text"))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, tag, fy, fp, form, val, filed, pos) of company-facts files named <entity>.json."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("entity"), F.col("value"))
    return raw.select("entity", F.inline(company_facts(F.col("value"))))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, date, close) from CSV files; zones are dropped from dates and rows without a close go."""
    rows = spark.read.csv(path, header=True, schema="ticker string, date string, close double")
    return rows.select("ticker", F.to_date(F.substring("date", 1, 10)).alias("date"), "close").where("close is not null and date is not null")


def key_map(listing: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """(doc_id, key) of a bucket listing: the document is the file's name without its ending; of several keys the one listed last."""
    stem = F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"\.[^.]*$", "")
    return listing.groupBy(stem.alias("doc_id")).agg(F.max_by(key, order).alias("key"))
