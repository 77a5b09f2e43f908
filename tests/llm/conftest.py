"""A small folder of odd tables: nulls, empty and long texts, ties, repeated rows, other columns."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
LINE = "a passage of some length that turns up in more than one of the documents here. "
DOCS = [
    (5, LINE * 3 + "tail five", "en", "src0"), (3, "start three " + LINE * 3, "en", "src1"),
    (7, None, None, None), (8, "", "en", "src0"), (9, " \t\n", "de", "src2"), (10, "One two", "fr", "x"),
    (None, "no id here " + LINE, "en", "src0"), (11, "Ünï cödé ä" * 30, "de", "src3"),
    (12, "w " * 30_000, "en", "src0"), (13, LINE, "en", "src1"), (13, LINE, "en", "src1"),
    (14, "x" * 200, "en", "src9"), (15, "x" * 90, "en", "src9"), (16, "One two", "fr", "x"),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, value string, a int, kept boolean"
PAGES = [
    (1, "https://A.example.com/en/1?q", "<body><nav>Menu</nav><article><h1>T</h1><p>Words &amp; more.</article>"),
    (2, None, None), (3, "no scheme", ""), (4, "http://x.net/es/a", "<p>open <b>text"),
    (4, "http://x.net/es/a", "<p>open <b>text"), (5, "http://www.example.com/en/", "<script>x<p>"),
    (6, "http://ads.example.org/x", "plain"), (None, "http://com/", "<div class=ad>buy</div>"),
    (7, "http://example.com", "<p>a</p>" * 3000), (8, "://", "<!-- x"),
]
PAGE_SCHEMA = "page_id long, url string, html string, text string, rule string"


WIDE = [float(i % 7) for i in range(64)]
VECTORS = [
    (1, [0.5] * 64), (2, [0.5] * 64), (2, [-0.25] * 64), (3, None), (4, [1.0] * 63), (5, [0.1] * 65),
    (6, [None] + [0.1] * 63), (7, [float("nan")] + [0.1] * 63), (8, [float("inf")] + [0.1] * 63),
    (None, [0.5001] * 64), (None, WIDE), (9, []), (10, [1e6 + i for i in range(64)]),
    (11, [-1e6] * 64), (12, WIDE), (13, [0.0005 * i for i in range(64)]), (14, [-0.0] * 64),
    (15, [0.3] * 64), (16, [0.3] * 64), (17, [3e30] * 64), (18, [-0.9] * 64), (19, [0.7] * 64),
]
VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, place long, row long, cluster int"


def write(spark, folder, docs, pages, labels, vectors=()):
    rows = [(*v, 1, 2, 3, 4) for v in vectors]
    spark.createDataFrame(rows, VECTOR_SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    rows = [(*d, None if d[1] is None else len(d[1]), 1, "v", 2, None) for d in docs]
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    pages = [(*p, "t", "r") for p in pages]
    spark.createDataFrame(pages, PAGE_SCHEMA).write.parquet(f"{folder}/pages.parquet")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    labels = [(5, 1, 0, "t"), (3, 1, 0, "t"), (12, 0, 0, "t"), (None, 1, 0, "t"), (99, 0, 0, "t"),
              (12, None, 0, "t")]
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS, PAGES, labels, VECTORS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="session")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
