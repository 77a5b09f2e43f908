"""A folder of tables that changes all at once.

Each build writes into folders of its own, ``<table>/build=<id>`` or, for a table cut by a
column, ``<table>/<column>=<value>/build=<id>``. A manifest names the folders and the
schema of every table. Readers take the manifest with the highest number, and writing it
is a build's last step: a build broken off before leaves the old tables as they were, and
its folders are found by no one. A build may keep folders of the one before, so adding rows
to one part rewrites that part alone. One build at a time: the second to publish on the
same manifest is refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS, BUILD = "_manifests", "build"


class Conflict(RuntimeError):
    """Another build was published meanwhile."""


@dataclass(frozen=True)
class Table:
    """A table's columns, the column that cuts it, if any, and its folders below the target."""

    schema: str
    folders: tuple[str, ...]
    cut_by: str | None = None

    def part(self, folder: str) -> str | None:
        """The value of ``cut_by`` that a folder holds, as text."""
        return folder.split("/")[1].partition("=")[2] if self.cut_by else None


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)


class Store:
    """Files below ``target``, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}".rstrip("/"))

    def list(self, pattern: str) -> list[str]:
        """Paths below the target that fit a glob, in order."""
        root = self.fs.makeQualified(self.path("")).toUri().getPath().rstrip("/") + "/"
        found = self.fs.globStatus(self.path(pattern)) or []
        return sorted(status.getPath().toUri().getPath().removeprefix(root) for status in found)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a whole file under a name not taken, by renaming it there; False if taken."""
        waiting = self.path(f"{name}.{uuid4().hex}")
        stream = self.fs.create(waiting)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(self.path(name)) and self.fs.rename(waiting, self.path(name)):
            return True
        self.fs.delete(waiting, False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifests(store: Store) -> list[str]:
    return [name for name in store.list(f"{MANIFESTS}/*.json") if name.endswith(".json")]


def load(store: Store, name: str) -> Manifest:
    kept = json.loads(store.read(name))
    tables = {
        key: Table(t["schema"], tuple(t["folders"]), t["cut_by"]) for key, t in kept["tables"].items()
    }
    return Manifest(kept["number"], tables)


def current(spark: SparkSession, target: str) -> Manifest | None:
    """The manifest that counts, None before the first build."""
    store = Store(spark, target)
    names = manifests(store)
    return load(store, names[-1]) if names else None


def read(spark: SparkSession, target: str, name: str, table: Table) -> DataFrame:
    """The rows of a table as a manifest has it; the cutting column prunes folders."""
    schema = StructType.fromJson(json.loads(table.schema))
    if not table.folders:
        return spark.createDataFrame([], schema)
    root = target.rstrip("/")
    paths = [f"{root}/{folder}" for folder in table.folders]
    found = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths)
    return found.select(*schema.names)


class Build:
    """New tables beside those of the manifest it starts from, until ``publish``."""

    def __init__(self, spark: SparkSession, target: str, anew: bool = False):
        self.spark, self.target = spark, target.rstrip("/")
        self.store = Store(spark, target)
        self.base = current(spark, target) or Manifest()
        self.tables = {} if anew else dict(self.base.tables)
        self.id = f"b{uuid4().hex}"

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.target, name, self.tables[name])

    def write(
        self, name: str, df: DataFrame, cut_by: str | None = None, balanced: bool = False
    ) -> None:
        """The whole table anew; ``balanced`` if ``df`` is rebalanced by ``cut_by`` already."""
        folders = self._written(name, df, cut_by, balanced)
        self.tables[name] = Table(df.schema.json(), folders, cut_by)

    def append(self, name: str, df: DataFrame) -> None:
        """More rows for a table; the folders it has stay."""
        table = self.tables[name]
        folders = (*table.folders, *self._written(name, df, table.cut_by))
        self.tables[name] = Table(table.schema, folders, table.cut_by)

    def replace(self, name: str, df: DataFrame, values: list) -> None:
        """The rows of some values of the cutting column anew; other folders stay."""
        table, gone = self.tables[name], {str(v) for v in values}
        kept = tuple(f for f in table.folders if table.part(f) not in gone)
        folders = (*kept, *self._written(name, df, table.cut_by))
        self.tables[name] = Table(table.schema, folders, table.cut_by)

    def _written(
        self, name: str, df: DataFrame, cut_by: str | None, balanced: bool = False
    ) -> tuple[str, ...]:
        """Write ``df`` and give its folders.

        A cut table is rebalanced by its column: adaptive execution splits a large value
        into tasks of ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and joins small
        ones, so files follow the size of the table and not the tasks that made it.
        """
        if cut_by is None:
            df.write.parquet(f"{self.target}/{name}/{BUILD}={self.id}")
            return (f"{name}/{BUILD}={self.id}",)
        dealt = df if balanced else df.hint("rebalance", F.col(cut_by))
        own = dealt.withColumn(BUILD, F.lit(self.id))
        own.write.mode("append").partitionBy(cut_by, BUILD).parquet(f"{self.target}/{name}")
        return tuple(self.store.list(f"{name}/{cut_by}=*/{BUILD}={self.id}"))

    def publish(self) -> Manifest:
        """Let readers see this build's tables."""
        number = self.base.number + 1
        text = {
            "number": number,
            "tables": {
                name: {"schema": t.schema, "folders": t.folders, "cut_by": t.cut_by}
                for name, t in self.tables.items()
            },
        }
        if not self.store.write_new(f"{MANIFESTS}/{number:09d}.json", json.dumps(text)):
            raise Conflict(f"{self.target} was built anew since build {self.base.number}")
        return Manifest(number, self.tables)


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last ``keep`` manifests names, and older manifests.

    Not while a build runs: its folders are in no manifest yet.
    """
    store = Store(spark, target)
    names = manifests(store)
    last = [load(store, name) for name in names[-keep:]]
    used = {folder for m in last for t in m.tables.values() for folder in t.folders}
    found = [*store.list(f"*/{BUILD}=*"), *store.list(f"*/*/{BUILD}=*")]
    gone = [folder for folder in found if folder not in used]
    for name in [*names[:-keep], *gone]:
        store.delete(name)
    return gone
