"""What the operators share: reading, cutting lineage, let-bindings, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run; once a session."""
    if getattr(spark.sparkContext, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry-package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._quarry_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_quarry_shared", None) or f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark._quarry_shared = found
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the files, so a lost executor costs no upstream work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a cut that nothing reads any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice which finished shuffles nothing refers to; Spark then deletes their files.

    It would on its own at the next garbage collection, which a driver with little to do may put off for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """In a Python worker, at the end of a task: give freed memory back, since the worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it in inner lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """All words of a text; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node reachable, for every node on a link.

    Alternates large-star and small-star steps (Kiveris et al., 2014); every round is cut, so
    lineage stays short. Minima are combined before the shuffle, and the joins back may be split by AQE.
    """
    now = cut(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links"
    )
    state = _fingerprint(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        star = large.join(small, "hi").select(
            F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")
        )
        new = cut(star.select("e.lo", "e.hi").where("hi <> lo").distinct(), "links")
        after = _fingerprint(new)
        drop_cut(now)
        now = new
        if after == state:
            break
        state = after
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x")).first()
    return row["n"], row["x"]
