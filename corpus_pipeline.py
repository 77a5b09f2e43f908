"""From documents to packed sequences: rules, near-duplicates, repeats, mix, packing.

Each stage takes what the one before it kept, written as Parquet and read again, and all
but the last return the columns of documents. The mix asks for ``MIX_PERCENT`` of the
tokens that reach it, a document once at most.

Defined cases: a null, empty or very short text fails the base rules and goes; rows without
an id stay through near-duplicates and repeats and are mixed as rows of their leaf; of
repeated rows one stays, the first by id, fingerprint and text; a text is taken whole,
however long; an empty table gives empty tables at every stage; other columns are left
out, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import mixing, packing, quality, simhash, suffixes
from shelfmark.llm.common import DOCUMENTS, LABELS, table, typed
from shelfmark.llm.ship import ship
from shelfmark.sources.shared import settle

MIX_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field keep."""
    docs = typed(docs, DOCUMENTS)
    field = quality.train_lines(docs, table(spark, sf_dir, "labels", LABELS))
    return quality.keep(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash component."""
    return simhash.keep_first(typed(docs, DOCUMENTS), shingle=3, radius=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings of documents with smaller ids."""
    left = suffixes.remove_repeats(typed(docs, DOCUMENTS), as_text=True)
    return left.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source",
        F.length("kept").cast("long").alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their domain, language and source."""
    return mixing.mix_documents(typed(docs, DOCUMENTS), percent=MIX_PERCENT, epochs=1)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens."""
    return packing.pack_documents(typed(docs, DOCUMENTS))


def shipped(stage):
    """``stage`` after bringing the package to the workers."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (stage.__name__, shipped(stage))
    for stage in (quality_rules, near_duplicates, repeated_passages, mix_sources, pack_sequences)
]

#: SQL has no decoding of a trained field and no subword tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of ``sf_dir`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
