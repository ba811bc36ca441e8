"""Versioned caches: upserts, set differences and read-through over DataFrames and Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarry.operators.storage import Conflict, Manifest


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes last."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def missing(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(have.select(*key), key, "left_anti")


def read_through(wanted: DataFrame, have: DataFrame, compute: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Cached rows where there are any; the others are computed. The key holds whatever the result depends on."""
    cached = have.join(wanted.select(*key).distinct(), key, "left_semi")
    return cached.unionByName(compute(missing(wanted, have, key)))


def write_cache(rows: DataFrame, path: str, by: str) -> None:
    """Write rows by partition; only partitions that rows have are replaced, so other keys' entries stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_cache(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The cache, empty where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def diff_cache(differences: DataFrame) -> DataFrame:
    """(key, items): a row for each pair of versions, its differences in order as one array; the key is old|new."""
    items = [c for c in differences.columns if c not in ("old_id", "new_id")]
    first = ["place", *[c for c in items if c != "place"]]
    key = F.concat_ws("|", "old_id", "new_id").alias("key")
    return differences.groupBy("old_id", "new_id").agg(F.array_sort(F.collect_list(F.struct(*first))).alias("items")).select(key, "items")


def returns_cache(by_ticker: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, studies): a row for each key, its regressions as one array in their order of place and window."""
    fields = ["study", "place", "group", "window", "n", "coef", "intercept", "t_stat", "r2", "rmse", "mae"]
    return by_ticker.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("studies"))


class VectorStore:
    """Passages with their vectors under one folder, kept in step with a corpus: what is new or has another text is embedded and added, what is gone is deleted.

    A sync writes its additions and its deletions (keys) as folders of their own and commits both at once, in a manifest that lists the folders in order; a
    row is live unless a later folder deletes its key. A writer that dies before the commit leaves the version before; of two writers the slower one starts over from the
    other's version. Once FOLDERS have gathered, the live rows are written as one, so a read is one scan of additions and one of deletions, however many syncs there were. Keys are unique.
    """

    FOLDERS = 16

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key, self.manifest = spark, path.rstrip("/"), key, Manifest(spark, path)

    def _scan(self, folders: list[str]) -> DataFrame:
        """Rows of folders with their place in the list."""
        rows = self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in folders])
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.withColumn("_at", F.array_position(F.array(*map(F.lit, folders)), name))

    def _live(self, version: int) -> DataFrame | None:
        folders = self.manifest.read(version).get("folders", [])
        added = [n for n in folders if n.startswith("add-")]
        if not added:
            return None
        rows = self._scan(folders=added)
        places = F.array(*map(F.lit, folders))
        rows = rows.withColumn("_at", F.array_position(places, F.element_at(F.array(*map(F.lit, added)), F.col("_at").cast("int"))))
        gone = [n for n in folders if n.startswith("del-")]
        if gone:
            last = self._scan(gone).withColumn("_at", F.array_position(places, F.element_at(F.array(*map(F.lit, gone)), F.col("_at").cast("int")))).groupBy(self.key).agg(F.max("_at").alias("_gone"))
            rows = rows.join(last, self.key, "left").where("_gone is null or _at > _gone").drop("_gone")
        return rows.drop("_at")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All live rows, or null for a new store."""
        rows = self._live(self.manifest.version() if version is None else version)
        return None if rows is None else rows.drop("_hash")

    def _write(self, rows: DataFrame, kind: str, rows_per_file: int) -> tuple[str, int]:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/data/{name}")
        n = self.spark.read.schema(rows.select(self.key).schema).parquet(f"{self.path}/data/{name}").count()
        if not n:
            self.manifest.delete(name, "data")
        return name, n

    def sync(self, chunks: DataFrame, embed: Callable[[Column], Column], rows_per_file: int = 5000) -> dict[str, int]:
        """Bring the store in step with the chunks (key, text, ...); how many rows were added and removed, a changed text counting as both."""
        hashed = chunks.withColumn("_hash", F.md5(F.coalesce("text", F.lit(""))))
        while True:
            base = self.manifest.version()
            have = self._live(base)
            todo, removed, written = hashed, 0, []
            if have is not None:
                held, wanted = have.select(self.key, "_hash"), hashed.select(self.key, "_hash")
                deleted, removed = self._write(held.join(wanted, [self.key, "_hash"], "left_anti").select(self.key), "del", rows_per_file)
                written += [deleted] if removed else []
                todo = missing(hashed, have, [self.key, "_hash"])
            name, added = self._write(todo.withColumn("embedding", embed(F.col("text"))), "add", rows_per_file)
            written += [name] if added else []
            if not written and base:
                return {"added": 0, "removed": 0}
            try:
                self.manifest.commit({"folders": [*self.manifest.read(base).get("folders", []), *written]}, base + 1)
            except Conflict:
                for n in written:
                    self.manifest.delete(n, "data")
                continue
            self.compact(rows_per_file)
            return {"added": added, "removed": removed}

    def compact(self, rows_per_file: int = 5000, least: int | None = None) -> bool:
        """Write the live rows as one folder if there are `least` folders; given up where another writer commits meanwhile."""
        base = self.manifest.version()
        if len(self.manifest.read(base).get("folders", [])) < (least or self.FOLDERS):
            return False
        name, n = self._write(self._live(base), "add", rows_per_file)
        try:
            self.manifest.commit({"folders": [name] if n else []}, base + 1)
        except Conflict:
            self.manifest.delete(name, "data")
            return False
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last `keep` versions lists; only when no writer is at work."""
        last = self.manifest.version()
        live = {n for v in range(max(1, last - keep + 1), last + 1) for n in self.manifest.read(v)["folders"]}
        gone = sorted(set(self.manifest.names("data")) - live)
        for n in gone:
            self.manifest.delete(n, "data")
        return gone
