"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    classifier,
    hilbert,
    html,
    lm,
    mixing,
    packing,
    periodic,
    prefixhash,
    quality,
    simhash,
    suffixes,
    toxicity,
    urls,
)
from shelfmark.llm.common import DOCUMENTS, LABELS, PAGES, table
from shelfmark.llm.ship import ship


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the line field's verdict on every document."""
    docs = table(spark, folder, "documents", DOCUMENTS)
    field = quality.train_lines(docs, table(spark, folder, "labels", LABELS))
    return quality.judge(docs, field)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in sequences of up to 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents", DOCUMENTS))


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, two bits."""
    found = simhash.components(table(spark, folder, "documents", DOCUMENTS), 3, 2)
    return found.withColumn("fingerprint", simhash.hex_digits("fingerprint"))


def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return prefixhash.compare_with_next(table(spark, folder, "documents", DOCUMENTS))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return urls.judge(table(spark, folder, "pages", PAGES))


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes left of every document without strings of 50 bytes from smaller ids."""
    docs = table(spark, folder, "documents", DOCUMENTS).select("doc_id", "text")
    return suffixes.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by a Kneser-Ney model of those not held out."""
    return lm.score(table(spark, folder, "documents", DOCUMENTS))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of every document, learned from those not held out."""
    docs = table(spark, folder, "documents", DOCUMENTS)
    return classifier.score(docs, classifier.train(docs, table(spark, folder, "labels", LABELS)))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is taken for a mix of four fifths of all tokens."""
    return mixing.choose(table(spark, folder, "documents", DOCUMENTS))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, folder, "pages", PAGES))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after ten rounds around eight centroids."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return hilbert.digest(hilbert.cluster(vectors, k=8, rounds=10, width=64, salt="3:"), vectors)


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from those not held out."""
    docs = table(spark, folder, "documents", DOCUMENTS)
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels", LABELS)))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document's words, and digests of the text without repeats."""
    docs = table(spark, folder, "documents", DOCUMENTS)
    return periodic.digest(periodic.detect(docs, periodic.planted))


def shipped(query: Callable[[SparkSession, str], DataFrame]):
    """``query`` after bringing the package to the workers."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f)
    for f in (
        op1_quality_rules, op2_packing, op3_simhash_near_dedup, op4_document_fingerprints,
        op5_url_filters, op6_suffix_array_dedup, op7_lm_scoring, op8_quality_classifier,
        op9_mixing, op10_html_extraction, op11_centroid_clustering, op12_toxicity,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op5_url_filters": urls.oracle(),
    "op9_mixing": mixing.oracle(),
    "op11_centroid_clustering": hilbert.oracle(),
}
