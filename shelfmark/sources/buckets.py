"""Tables kept in buckets of a key, so that repeated joins on it do not shuffle them.

Two tables in equally many buckets of a key join bucket by bucket. A bucket is one task,
and no one splits it, so keys with more than a bucket's share of the rows are kept apart:
there are fewer of them than buckets, their dimension rows are broadcast, and their rows
stay where they were read.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.shared import new_table_path, settle


#: Rows of a bucket, which one task sorts and joins.
BUCKET_ROWS = 2_000_000


def enough_buckets(df: DataFrame, least: int = 8, rows: int = BUCKET_ROWS) -> int:
    """Buckets of up to ``rows`` rows on average, so that a task's share does not grow."""
    return max(least, -(-df.count() // rows))


@dataclass(frozen=True)
class Bucketed:
    """A table in buckets of ``key``; ``hot`` has the rows of its frequent values."""

    key: str
    buckets: int
    cool: str
    hot: DataFrame
    hot_keys: DataFrame

    def join(self, spark: SparkSession, dimension: str) -> DataFrame:
        """The rows with those of a dimension table, as ``write_dimension`` wrote it, inner."""
        rows = spark.table(dimension)
        # fewer rows than buckets
        few = F.broadcast(rows.join(F.broadcast(self.hot_keys), self.key, "left_semi"))
        cool = spark.table(self.cool).hint("merge").join(rows, self.key)
        return cool.unionByName(self.hot.join(few, self.key))


def _save(df: DataFrame, key: str, buckets: int, name: str) -> str:
    """Write one file a bucket, sorted by the key, as a table of the session's catalog."""
    table = f"{name}_{uuid4().hex}"
    (
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        .option("path", new_table_path(df.sparkSession, name)).saveAsTable(table)
    )
    return table


def write_dimension(df: DataFrame, key: str, buckets: int, name: str) -> str:
    """The catalog name of a table whose ``key`` is unique, in buckets."""
    return _save(df, key, buckets, name)


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> Bucketed:
    """``df`` in buckets of ``key``, rows of its frequent values apart.

    A value is frequent if it has more than a bucket's share of all rows.
    """
    counts = settle(df.groupBy(key).agg(F.count("*").alias("key_rows")), "key_rows")
    share = counts.agg((F.sum("key_rows") / buckets).alias("share"))
    hot_keys = settle(
        counts.join(F.broadcast(share), F.col("key_rows") > F.col("share")).select(key), "hot_keys"
    )
    hot = settle(df.join(F.broadcast(hot_keys), key, "left_semi"), f"{name}_hot")
    cool = df.join(F.broadcast(hot_keys), key, "left_anti")
    return Bucketed(key, buckets, _save(cool, key, buckets, name), hot, hot_keys)


def drop(spark: SparkSession, *tables: str) -> None:
    """Forget tables in the catalog; ``shared.release`` deletes their files."""
    for table in tables:
        spark.sql(f"drop table if exists {table}")
