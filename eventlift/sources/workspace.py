"""Materialised steps.

A study is a chain of tables, each read by several later steps. Writing a step cuts
its lineage (a lost executor re-reads a file instead of redoing the chain) and lets
the planner see its true size, so that Spark's own threshold decides on a broadcast.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else the session's warehouse.

    A warehouse on a local disk counts only in a local session; on a cluster the other
    machines would not see it, and the setting has to be made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_disk = ":" not in warehouse or warehouse.startswith("file:")
    if on_disk and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return warehouse


class Folder:
    """A folder on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._system = self._at().getFileSystem(self._conf)

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """The names of what the folder holds; none if it is not there."""
        if not self.exists():
            return []
        return sorted(entry.getPath().getName() for entry in self._system.listStatus(self._at()))

    def entries(self) -> list[tuple[str, int, int]]:
        """Name, size and time of change of what the folder holds."""
        found = self._system.listStatus(self._at())
        return sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in found)

    def exists(self, name: str = "") -> bool:
        return self._system.exists(self._at(name))

    def rename(self, name: str, to: str) -> bool:
        """Whether the rename took place; what already has the new name stays as it is."""
        return not self.exists(to) and self._system.rename(self._at(name), self._at(to))

    def delete(self, name: str = "") -> None:
        self._system.delete(self._at(name), True)


#: What says that a run is alive, and for how long after its last step.
LEASE, LEASE_HOURS = "_lease", 24.0


class Workspace:
    """Tables of one run, under a folder of its own in the shared folder.

    The folder goes with ``drop()``, at the end of a ``with`` block, or at the latest
    when the driver's JVM ends. ``views`` is put before the names of views, so that two
    studies in a session keep theirs apart.

    With ``keep``, a name for the run, the folder stays when the driver ends, and steps lie under a
    fingerprint of what they compute and read. A run of the same name takes whole steps as they are, so
    a killed one goes on where it was; a step whose inputs or definition have changed is
    another step. One driver at a time may use a name.

    Each step renews the run's lease. ``sweep`` removes the folders of runs whose lease is over, as
    those of killed drivers.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, views: str = "", keep: str | None = None):
        self.spark = spark
        name = f"kept-{keep}" if keep else f"run-{uuid.uuid4().hex}"
        self.root = f"{root or shared_folder(spark)}/{name}"
        self.views = views
        self.keep = keep
        self._numbers = itertools.count()
        self._file_system().mkdirs(self._path())
        if not keep:
            self._file_system().deleteOnExit(self._path())  # only marks what exists
        self._renew()

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _file_system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _renew(self) -> None:
        self._file_system().create(self._path(LEASE), True).close()

    def new_path(self, name: str) -> str:
        """A path in the folder that no other step uses."""
        return f"{self.root}/{next(self._numbers):03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table that reads it back."""
        mark = fingerprint(df) if self.keep else None
        path = f"{self.root}/{name}-{mark}" if mark else self.new_path(name)
        self._renew()
        if not mark or not Folder(self.spark, path).exists("_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def create_or_replace(self, df: DataFrame, name: str) -> DataFrame:
        """``stage`` plus a temporary view of that name for SQL users."""
        table = self.stage(df, name)
        table.createOrReplaceTempView(f"{self.views}{name}")
        return table

    def drop(self) -> None:
        """Delete the tables of this run. DataFrames that read them stop working."""
        self._file_system().delete(self._path(), True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()


def fingerprint(df: DataFrame) -> str | None:
    """Tells apart what frames compute and the files they read (names, sizes, times of change).

    None where that cannot be told: rows that came from the driver are not part of the plan's text.
    """
    spark = df.sparkSession
    fields = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(fields)
    spark.conf.set(fields, str((1 << 31) - 1))
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(fields, before)
    if re.search(r"\b(LogicalRDD|LocalRelation|ExternalRDD)\b", plan):
        return None
    files = [f.rpartition("/") for f in df.inputFiles()]
    listed = []
    for parent in sorted({p for p, _, _ in files}):
        folder, names = Folder(spark, parent), {unquote(n) for p, _, n in files if p == parent}
        listed += [(parent, *entry) for entry in folder.entries() if entry[0] in names]
    text = re.sub(r"#\d+L?", "", plan) + repr(sorted(listed))
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def sweep(spark: SparkSession, root: str | None = None, hours: float = LEASE_HOURS) -> list[str]:
    """Remove the folders of runs that have not begun a step for so many hours; returns their names."""
    folder = Folder(spark, root or shared_folder(spark))
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), []
    for name in folder.names():
        if not name.startswith(("run-", "kept-")):
            continue
        lease = [time for entry, _, time in Folder(spark, f"{folder.path}/{name}").entries() if entry == LEASE]
        if lease and now - lease[0] > hours * 3_600_000:
            folder.delete(name)
            gone.append(name)
    return gone
