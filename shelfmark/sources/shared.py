"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Compression of tables as large as the fact: by about a third smaller here than Spark's default.
SMALLEST = "zstd"

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster
    session without it is refused: a machine-local folder would be lost with
    its machine.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="shelfmark-")
    return _local_folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path for a new intermediate table of this application."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{shared_folder(spark)}/shelfmark/{app}/{name}-{uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy has a short lineage, fixed contents whatever executors are lost,
    and a size Spark knows when it plans, so a later join broadcasts it only
    when it really is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of change of every file below a folder: other if its data are."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, files = [], root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def release(spark: SparkSession) -> None:
    """Delete all tables that this application settled; their DataFrames are lost."""
    app = spark.conf.get("spark.app.id", "app")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/shelfmark/{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
