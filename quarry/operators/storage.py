"""What all of a job's processes share: the package, a folder; and versioned manifests with atomic commits."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_quarry_shared", None) or f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark._quarry_shared = found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there, for a costly table that several parts of a result read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


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


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt where their work, not their bytes, counts: two a core, at least as many as other shuffles have."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fingerprint(spark: SparkSession, path: str) -> str:
    """A path with its files' names, sizes and times: another text as soon as something is written there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return path + "|" + ";".join(sorted(f"{s.getPath().getName()},{s.getLen()},{s.getModificationTime()}" for s in fs.listStatus(at)))


class Conflict(Exception):
    """Another writer has committed this version."""


class Manifest:
    """What a folder's readers see: a small JSON document a version, committed by a rename that fails where the version exists.

    Data are written before under names of their own, so a writer that dies leaves the version before readable, and of two writers one wins and the
    other starts over from what the winner left.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_pkg, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs_pkg.Path(f"{self.root}/{name}")

    def fs(self):
        return self._path("").getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs().listStatus(at)] if self.fs().exists(at) else []

    def version(self) -> int:
        """The latest version; 0 for a new folder."""
        return max((int(n[1:-5]) for n in self.names("manifest") if re.fullmatch(r"v\d+\.json", n)), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.fs().open(self._path(f"manifest/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, content: dict, version: int) -> int:
        """Make the content this version, or raise Conflict."""
        aside = self._path(f"manifest/_{uuid.uuid4().hex}")
        out = self.fs().create(aside, False)
        out.write(json.dumps(content).encode())
        out.close()
        context = self._fs_pkg.FileContext.getFileContext(self._path("").toUri(), self._conf)
        options = self.spark._sc._gateway.new_array(getattr(self._fs_pkg, "Options$Rename"), 0)
        try:
            context.rename(aside, self._path(f"manifest/v{version:010d}.json"), options)
        except Py4JJavaError as e:
            if self.version() < version:
                raise  # not a lost race
            self.delete(aside.getName(), "manifest")
            raise Conflict(f"version {version} exists") from e
        return version

    def change(self, edit) -> int:
        """Commit edit(content) on top of the latest version, again where another writer was faster. `edit` may raise Conflict to give up."""
        while True:
            base = self.version()
            content = edit(self.read(base))
            try:
                return self.commit(content, base + 1)
            except Conflict:
                continue

    def delete(self, name: str, folder: str) -> None:
        self.fs().delete(self._path(f"{folder}/{name}"), True)
