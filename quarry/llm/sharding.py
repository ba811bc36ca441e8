"""Size-tiered compaction of immutable shards under versioned manifests, in DataFrame functions only.

append() writes the arriving rows as they are dealt, without a shuffle, as shards of at most
ARRIVAL_ROWS rows; arrive() does so for a table that comes in several arrivals, in one scan and with a version for each arrival.
compact() puts shards below half of TARGET bytes into tiers of similar size (a factor FAN_IN each), cuts
every tier into runs of up to TARGET bytes and ROWS rows and rewrites each run of two or more as one file; other shards
stay untouched. Rows are dealt straight to their run's task, so a task reads one run and nothing
else, whatever keys the rows have. Runs form within slots of at most about SLOT shards and are numbered within them, so planning has no
task over all shards; only one number a slot is summed up over all. compact_all() goes on until no tier has two shards to merge.

A manifest is the list of shards of one version, in parts of at most PART rows: live ones, and dead ones as long as their folder holds a live one.
It is written aside and renamed to its version's name, which
fails if that version exists: readers see the old or the new list, and of two writers one wins. The other one adds what it has
written to the winner's list; a compaction whose shards the winner has replaced starts over. (The rename must be atomic and
must not replace, as on HDFS and local disks; stores without that need another way to take a version's name.) Files are
never changed; what no manifest lists is not read, so failed or repeated
tasks and lost executors leave nothing visible. Readers list folders, one or two a commit, not shards, and leave out the few dead shards among them
(a broadcast of at most SENT paths, else a join). vacuum() deletes folders that no version since a given one reads.

Any columns (also those named like the ones used here: helper columns have generated names), nulls, equal rows and texts of any
length are stored as they are. An empty table makes a version with no
shard (its rows are none, its schema is kept in the store). Shards of equal size are told apart by their paths.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.common import cut, drop_cut, shared_dir, table

TARGET = 32 << 20
ROWS = 1 << 20
SMALLEST = 1 << 16
FAN_IN = 4
ARRIVAL_ROWS = 4096
#: The registered query deals its table out to so many arrivals.
ARRIVALS = 4
SLOT = 4096
PART = 50_000
#: A plan of at most so many shards is sent to all tasks; a larger one is joined by shuffle.
SENT = 100_000
_SHARDS = T.StructType(
    [T.StructField(n, k) for n, k in (("path", T.StringType()), ("folder", T.StringType()), ("bytes", T.LongType()), ("rows", T.LongType()), ("tier", T.IntegerType()), ("live", T.BooleanType()))]
)
#: The folder of a shard's path, below the store's root.
_FOLDER = "/(data/[ac]-[0-9a-f]{32}(?:/[^/]+)?)/[^/]+$"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def tier_of(size):
    """Tier of a shard by its bytes; full shards, of half a target or more, have one tier above all."""
    steps = F.floor(F.log(F.greatest(size, F.lit(SMALLEST)) / SMALLEST) / F.log(F.lit(float(FAN_IN))))
    return F.when(size >= TARGET // 2, 99).otherwise(steps).cast("int")


def fresh(*names: str) -> list[str]:
    """Names that no other column has."""
    tag = uuid.uuid4().hex
    return [f"{n}_{tag}" for n in names]


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # --- versions ---

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        fs = at.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The latest committed version; 0 for a new store."""
        return max((int(n[1:]) for n in self._names("manifests") if n[:1] == "v" and n[1:].isdigit()), default=0)

    def shards(self, version: int | None = None) -> DataFrame:
        """All listed shards, live and dead."""
        version = self.version() if version is None else version
        if not version:
            return self._empty(_SHARDS)
        return self.spark.read.schema(_SHARDS).parquet(f"{self.root}/manifests/v{version:010d}")

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.shards(version).where("live").drop("live")

    def commit(self, shards: DataFrame, version: int, parts: int = 1) -> int:
        """Make the list of shards this version, or raise Conflict."""
        aside = f"manifests/_{uuid.uuid4().hex}"
        shards.select(*_SHARDS.names).repartition(parts).write.parquet(f"{self.root}/{aside}")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        options = self.spark._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(aside), self._path(f"manifests/v{version:010d}"), options)
        except Py4JJavaError as e:
            if self.version() < version:
                raise  # not a lost race
            self._delete(aside)
            raise Conflict(f"version {version} exists") from e
        return version

    def _delete(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self._conf).delete(path, True)

    def _with(self, base: int, replaced: DataFrame | None, added: DataFrame) -> tuple[DataFrame, int]:
        """(shards of the next version, its parts): replaced ones are dead, and go where their folder has no live one left."""
        now = self.shards(base)
        if replaced is not None:
            gone = replaced.select("path").withColumn("gone", F.lit(True))
            now = now.join(gone, "path", "left").withColumn("live", F.col("live") & F.col("gone").isNull()).drop("gone")
            some = now.where("live").select("folder").distinct()
            now = now.join(some, "folder", "left_semi")
        every = now.select(*_SHARDS.names).unionByName(added.withColumn("live", F.lit(True)).select(*_SHARDS.names))
        return every, 1 + (self.shards(base).count() + added.count()) // PART

    def _written(self, folder: str, schema: T.StructType) -> DataFrame:
        """The shards in a folder, from the rows' file metadata."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        file = rows.metadataColumn("_metadata")
        rows = rows.select(file["file_path"].alias("path"), file["file_size"].alias("bytes"))
        shards = rows.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        return shards.withColumn("folder", F.regexp_extract("path", _FOLDER, 1)).withColumn("tier", tier_of(F.col("bytes")))

    # --- writing ---

    def _add(self, folder: str, schema: T.StructType) -> int:
        """Commit a written folder on top of whatever version is the latest."""
        added = cut(self._written(folder, schema), "shards")
        while True:
            base = self.version()
            try:
                version = self.commit(*_swap(self._with(base, None, added), base + 1))
            except Conflict:
                continue
            drop_cut(added)
            return version

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", arrival_rows).parquet(folder)
        return self._add(folder, rows.schema)

    def arrive(self, rows: DataFrame, arrivals: int = ARRIVALS, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Append a table as so many arrivals, its rows dealt out in turn: one scan, and a version for each arrival."""
        (turn,) = fresh("turn")
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        dealt = rows.withColumn(turn, F.pmod(F.monotonically_increasing_id(), F.lit(arrivals)))
        dealt.write.option("compression", "zstd").option("maxRecordsPerFile", arrival_rows).partitionBy(turn).parquet(folder)
        found = [n for n in self._names(folder[len(self.root) + 1 :]) if "=" in n]
        for name in sorted(found):
            self._add(f"{folder}/{name}", rows.schema)
        return self.version() if found else self._add(folder, rows.schema)

    def plan(self, version: int) -> DataFrame:
        """(path, run): runs of shards to merge, runs numbered from 0."""
        small = self.manifest(version).where("tier < 99")
        slots = max(1, -(-small.count() // SLOT))
        small = small.withColumn("slot", F.pmod(F.xxhash64("path"), F.lit(slots)))
        before = Window.partitionBy("slot", "tier").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        sized = lambda c, most: F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / most)
        small = small.withColumn("no", F.struct(sized("bytes", TARGET).alias("b"), sized("rows", ROWS).alias("r")))
        runs = small.groupBy("slot", "tier", "no").agg(F.collect_list("path").alias("paths"), F.sum("bytes").alias("size")).where(F.size("paths") > 1)
        runs = runs.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy("tier", "no")) - 1)
        slots_ = runs.groupBy("slot").agg(F.count("*").alias("n"))
        first = slots_.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
        numbered = runs.join(first, "slot").select((F.col("first") + F.col("place")).alias("run"), (F.col("size") >= TARGET // 2).alias("full"), F.explode("paths").alias("path"))
        return numbered.withColumn("folder", F.regexp_extract("path", _FOLDER, 1))

    def compact(self, schema: T.StructType) -> int:
        """Merge every run of similarly sized shards; returns the version, a new one if anything was merged."""
        while True:
            base = self.version()
            plan = cut(self.plan(base), "plan")
            size = plan.agg(F.count("*").alias("shards"), F.max("run").alias("last")).first()
            if not size["shards"]:
                drop_cut(plan)
                return base
            sent = F.broadcast(plan) if size["shards"] <= SENT else plan
            folders = [r["folder"] for r in plan.select("folder").distinct().collect()]
            path, run, full = fresh("path", "run", "full")
            rows = self._rows(folders, schema)
            named = rows.select("*", rows.metadataColumn("_metadata")["file_path"].alias(path))
            dealt = named.join(sent.select(F.col("path").alias(path), F.col("run").cast("int").alias(run), F.col("full").cast("int").alias(full)), path)
            merged = f"{self.root}/data/c-{uuid.uuid4().hex}"
            # full and lesser shards have folders of their own: only the latter's are read again
            out = dealt.repartitionById(size["last"] + 1, F.col(run)).select(*[F.col(f"`{c}`") for c in schema.names], full)
            out.write.option("compression", "zstd").partitionBy(full).parquet(merged)
            added = cut(self._written(merged, schema), "shards")
            version = self._replace(base, plan, added)
            drop_cut(added)
            drop_cut(plan)
            if version:
                return version
            self._delete(merged[len(self.root) + 1 :])

    def _replace(self, base: int, plan: DataFrame, added: DataFrame) -> int:
        """Commit merged shards in the place of the planned ones; 0 if another writer has replaced some of these."""
        while True:
            try:
                return self.commit(*_swap(self._with(base, plan, added), base + 1))
            except Conflict:
                base = self.version()
                if plan.join(self.manifest(base), "path", "left_anti").count():
                    return 0

    def compact_all(self, schema: T.StructType, keep: int | None = None) -> int:
        """Compact until no run of two or more is left; with `keep`, folders only older versions read are deleted after each round."""
        version = self.version()
        while (after := self.compact(schema)) != version:
            version = after
            if keep is not None:
                self.vacuum(version - keep)
        return version

    def vacuum(self, since: int) -> int:
        """Delete the folders of data that no version from `since` on reads, and older manifests; readers of these must have ended."""
        versions = sorted(int(n[1:]) for n in self._names("manifests") if n[:1] == "v" and n[1:].isdigit())
        folders = lambda df: {r["folder"] for r in df.select("folder").distinct().collect()}
        used, old = set(), set()
        for v in versions:
            if v >= since:
                used |= folders(self.manifest(v))
            else:
                old |= folders(self.shards(v))
                self._delete(f"manifests/v{v:010d}")
        for name in old - used:
            self._delete(name)
        return len(old - used)

    # --- reading ---

    def _rows(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self._empty(schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, schema: T.StructType, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; `shard` names a column for their shard's path."""
        listed = self.shards(version)
        folders = [r["folder"] for r in listed.select("folder").distinct().collect()]
        dead = listed.where("not live").select("path")
        rows = self._rows(folders, schema)
        (path,) = fresh("path")
        named = rows.select("*", rows.metadataColumn("_metadata")["file_path"].alias(path)) if folders else rows.select("*", F.lit("").alias(path))
        n = dead.count()
        if n:
            gone = dead.withColumnRenamed("path", path)
            named = named.join(F.broadcast(gone) if n <= SENT else gone, path, "left_anti")
        return named.select(*[F.col(f"`{c}`") for c in schema.names], *([F.col(path).alias(shard)] if shard else []))


def _swap(listed: tuple[DataFrame, int], version: int) -> tuple[DataFrame, int, int]:
    shards, parts = listed
    return shards, version, parts


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents arrive in turns and are compacted until nothing is left to merge: doc_id, shard, tier, shard_rows, shard_bytes, version."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.arrive(docs)
    version = store.compact_all(docs.schema, keep=0)
    ids = T.StructType([f for f in docs.schema if f.name == "doc_id"])
    live = store.manifest(version).withColumnRenamed("path", "_shard")
    named = store.read(ids, version, "_shard").join(live, "_shard")
    shard = F.regexp_extract("_shard", "([^/]*)$", 1)
    return named.select("doc_id", shard.alias("shard"), "tier", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.lit(version).cast("long").alias("version"))
