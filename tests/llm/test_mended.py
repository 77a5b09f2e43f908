"""Exact weights of mixing, lines that switch, learning against a plain loop, rounds of links."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from shelfmark.llm import classifier, mixing, packing, quality, simhash
from tests.llm.conftest import SF


def tokens_by(chosen, level):
    found = Counter()
    for r in chosen:
        found[r[level]] += r.n_tokens * r.copies
    return found


def table_of(spark, leaves):
    """Documents of one word for each leaf (source, lang, tokens)."""
    rows = [(n * 10_000 + i, "w", lang, source) for n, (source, lang, many) in enumerate(leaves) for i in range(many)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def plain_sql(tmp_path, docs, **options):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(mixing.oracle(**options))
    columns = [c[0] for c in found.description]
    return columns, Counter(found.fetchall())


WEIGHTS = [
    {"domain": {"d0": 0.3, "d1": 0.7}}, {"domain": {"d0": "1/3", "d1": "2/3", "d2": 0}},
    {"source": {"src0": 0, "src4": 0.5}, "lang": {"en": 2.25, "de": 0}}, {"lang": {"en": 0, "de": 0}}, {},
]


@pytest.mark.parametrize("weights", WEIGHTS)
@pytest.mark.parametrize("percent", [20, 50, 80])
def test_weights_are_exact_and_budgets_add_up(spark, tmp_path, weights, percent):
    leaves = [("src0", "en", 500), ("src4", "en", 100), ("src1", "de", 400), ("src1", "en", 300),
              ("src2", "fr", 200), ("src2", "de", 50), ("x", "en", 30)]
    docs = table_of(spark, leaves)
    options = {"percent": percent, "epochs": 1, "weights": weights}
    chosen = mixing.choose(docs, **options).collect()
    columns, want = plain_sql(tmp_path, docs, **options)
    assert Counter(tuple(r[c] for c in columns) for r in chosen) == want
    whole = mixing.whole_weights(weights)
    supply, budget = Counter(), {}
    for r in chosen:
        leaf = (r.domain, r.lang, r.source)
        if all(whole[level].get(r[level], whole[level][None]) for level in mixing.LEVELS):
            supply[leaf] += r.n_tokens
        budget[leaf] = r.leaf_budget
    assert sum(budget.values()) == min(1580 * percent // 100, sum(supply.values()))
    assert all(budget[leaf] <= supply[leaf] for leaf in budget)


def test_fractions_are_not_rounded(spark):
    docs = table_of(spark, [("src0", "en", 1000), ("src1", "en", 1000)])
    chosen = mixing.choose(docs, 50, 1, weights={"domain": {"d0": 0.3, "d1": 0.7}}).collect()
    assert tokens_by(chosen, "domain") == {"d0": 300, "d1": 700}


def test_a_leaf_without_weight_gives_its_parents_no_room(spark):
    docs = table_of(spark, [("src0", "en", 1000), ("src4", "en", 100), ("src1", "en", 1000)])
    weights = {"source": {"src0": 0}}
    chosen = mixing.choose(docs, 40, 1, weights=weights).collect()
    assert tokens_by(chosen, "source") == {"src0": 0, "src4": 100, "src1": 740}


@pytest.mark.parametrize("weights", [{"lang": {"en": -1}}, {"lang": {"en": 1e-12}}])
def test_weights_that_do_not_fit_are_errors(spark, weights):
    with pytest.raises(ValueError, match="lang"):
        mixing.choose(table_of(spark, [("src0", "en", 3)]), weights=weights)


def test_links_left_are_an_error(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert len({r.root for r in simhash.roots(edges).collect()}) == 1
    monkeypatch.setattr(simhash, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="rounds"):
        simhash.roots(edges)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels


def test_viterbi_finds_where_lines_switch(spark, labelled):
    docs, labels = labelled
    field = quality.train_lines(docs, labels)
    texts = defaultdict(list)
    for r in docs.join(labels, "doc_id").filter("quality is not null").orderBy("doc_id").collect():
        lines = [x for x in r.text.encode().split(b"\n") if x.split()]
        if len(lines) > 3:
            texts[r.quality].append(lines)
    right = lines = 0
    for good, bad in zip(texts[1], texts[0] * 9, strict=False):
        cut = len(good) // 2
        text = b"\n".join(good[:cut] + bad + good[cut:])
        numbers, flags, _, _ = quality.lines_of(text)
        slots = quality.line_features(np.array(numbers), np.array(flags, np.int64))
        label = quality.crf.viterbi(field, slots, np.array([len(slots)]))
        want = [1] * cut + [0] * len(bad) + [1] * (len(good) - cut)
        right, lines = right + int((label == want).sum()), lines + len(want)
        _, share, _, _ = quality.judged([text], field, quality.CONTENT_SHARE)
        assert 0 <= share[0] <= 1
    assert lines > 500 and right > 0.95 * lines


def test_spliced_sequences():
    width = len(quality.CUTS) + quality.FLAGS + 1
    good, bad = np.ones((4, width), np.int64), np.full((3, width), 2)
    (one, label), (other, switched) = quality.spliced(good, bad)
    assert label.tolist() == [1, 1, 0, 0, 0, 1, 1] and switched.tolist() == [0, 0, 1, 1, 1, 1, 0]
    first = len(quality.CUTS) + quality.FIRST
    at = quality.OFFSETS[-1] + 2 * quality.FIRST
    assert (one[:, first] - at).tolist() == [1, 0, 0, 0, 0, 0, 0] and (other[:, 0] == [2, 2, 1, 1, 1, 1, 2]).all()


def test_ftrl_is_that_of_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.random() < 0.2)) for _ in range(30)]
    got = classifier.learn(rows, turns=3)
    size = (1 << classifier.BITS) + 1
    z, n, w = defaultdict(float), defaultdict(float), {}
    many = Counter(label for *_, label in rows)

    def weight(i):
        if abs(z[i]) <= classifier.L1:
            return 0.0
        rate = (classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2
        return (math.copysign(classifier.L1, z[i]) - z[i]) / rate

    for _ in range(3):
        for slots, values, label in rows:
            x = {**dict(zip(slots.tolist(), values.tolist(), strict=True)), size - 1: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = len(rows) / (2 * many[label]) * (p - label) * v
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA
                z[i] += g - step * w[i]
                n[i] += g * g
    assert np.allclose(got[:40], [weight(i) for i in range(40)], atol=1e-5)
    assert abs(got[-1] - weight(size - 1)) < 1e-5


def test_held_out_documents_are_predicted(spark, labelled):
    docs, labels = labelled
    scored = classifier.score(docs, classifier.train(docs, labels)).join(labels, "doc_id")
    held = [(r.quality, r.predicted) for r in scored.filter("held_out and quality is not null").collect()]
    assert len(held) > 50 and sum(q == p for q, p in held) >= 0.95 * len(held)


def test_small_tables_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert mixing.choose(docs, weights={"domain": {"d0": 0.5}}).count() == docs.count()


def test_bytes_that_are_no_text(spark):
    rows = spark.sql("select 1L as doc_id, cast(x'ff20c320bcc3bc20616263c3' as string) as text")
    found = quality.judge(rows, None).collect()[0]
    assert (found.n_words, found.word_chars) == (4, 1 + 1 + 2 + 4)
    want = b"\xff \xc3 \xbc\xc3\xbc abc\xc3".decode(errors="replace")
    as_text = spark.createDataFrame([(1, want)], "doc_id long, text string")
    columns = ("start", "length", "ids_crc32", "doc_tokens")
    packed, same = (packing.pack_documents(x).select(*columns).collect() for x in (rows, as_text))
    assert sorted(packed) == sorted(same)
