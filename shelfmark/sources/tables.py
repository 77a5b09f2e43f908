"""Table readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from shelfmark.sources.records import records_parsed
from shelfmark.sources.schemas import RAW, struct
from shelfmark.sources.shared import settle

CORRUPT = "corrupt_record"
#: What the parser calls an empty field without quotes; with quotes it is an empty text.
ABSENT = "\1"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder as text columns named by its header, with doubled inner quotes.

    A record with another number of fields than the header has its text in
    ``corrupt_record``. Tasks share a file, also one with line breaks in quoted values; its
    records are then joined from lines and written once, while the DataFrame is being built.
    """
    options = {
        "quote": '"', "escape": '"', "nullValue": ABSENT, "emptyValue": "",
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
    }
    def reader(multi_line: bool) -> DataFrameReader:
        # all columns are parsed, or a record with too many fields would not show
        return spark.read.options(
            header=True, multiLine=multi_line, columnPruning=False, **options
        )

    names = [name.removesuffix("\r") for name in reader(True).csv(path).columns]
    text = ", ".join(f"`{name}` string" for name in [*names, CORRUPT])
    parse = F.from_csv("record", text, {**options, "multiLine": "true"})
    found = records_parsed(spark, path, parse)
    if found is None:
        found = reader(False).schema(struct(text)).csv(path)
    return found


def typed(text: Column, kind: DataType) -> Column:
    """Text as a value of ``kind``, NULL if it does not fit; 35.0 is the whole number 35."""
    if isinstance(kind, StringType):
        return text
    value = F.nullif(F.trim(text), F.lit(""))
    if isinstance(kind, IntegralType):
        exact = value.try_cast("decimal(30,6)")
        return F.when(exact == F.floor(exact), exact).try_cast(kind)
    return value.try_cast(kind)


def load_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the columns of ``schema``, and what did not fit: column_name, value.

    Columns are found by the header's names, in any order; a missing one is an error. A
    field that does not fit its type is NULL and one reject; of a record with too many
    fields the whole text is a reject too. The file is parsed once, into a settled table:
    Spark parses only the columns a query asks for, so straight from the file different
    queries would find different records corrupt.
    """
    fields = struct(schema).fields
    text = read_csv(spark, path)
    missing = [f.name for f in fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = settle(text.select(*(f.name for f in fields), CORRUPT), "loaded")
    rows = text.select(*(typed(F.col(f.name), f.dataType).alias(f.name) for f in fields))
    unfit = [
        F.when(
            F.trim(f.name).isNotNull() & (F.trim(f.name) != "")
            & typed(F.col(f.name), f.dataType).isNull(),
            F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("value")),
        )
        for f in fields
    ]
    whole = F.when(
        F.col(CORRUPT).isNotNull(),
        F.struct(F.lit(CORRUPT).alias("column_name"), F.col(CORRUPT).alias("value")),
    )
    found = text.select(F.explode(F.array_compact(F.array(*unfit, whole))).alias("reject"))
    return rows, found.select("reject.*")


def load_raw(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One raw table of the retail model from ``folder/<table>.csv``, with all its rows."""
    return load_csv(spark, f"{folder}/{table}.csv", RAW[table])[0]


def load_rejects(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """table_name, column_name, value of the fields of one raw table that do not fit."""
    rejects = load_csv(spark, f"{folder}/{table}.csv", RAW[table])[1]
    return rejects.select(F.lit(table).alias("table_name"), "column_name", "value")


def load_mapping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An old-id/new-id table as ``write_mapping`` writes it; it stays distributed."""
    return load_csv(spark, path, schema)[0]


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(struct(schema)).parquet(path)


def write_table(
    df: DataFrame, path: str, *partition_by: str, compression: str | None = None
) -> None:
    """Replace the Parquet table at ``path``, if there is one."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path, compression=compression)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace the CSV table at ``path``: header, doubled inner quotes, outer blanks kept.

    NULL is an empty field, an empty text a pair of quotes.
    """
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "").option("emptyValue", '""').csv(path)
    )


def write_mapping(df: DataFrame, path: str) -> None:
    """Replace the old-id/new-id table at ``path``, in the format of ``load_mapping``."""
    write_csv(df, path)


def write_fact(fact: DataFrame, path: str) -> None:
    """Replace the sales fact, one folder per order year for partition pruning.

    The rows are rebalanced by year: adaptive execution splits a large year into tasks
    of ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and joins small years, so the
    number of files follows the size of the fact and not the tasks that made it.
    """
    write_table(fact.hint("rebalance", F.col("order_year")), path, "order_year")
