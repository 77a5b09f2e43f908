"""Clustering, toxicity and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import hilbert, periodic, toxicity
from shelfmark.llm.queries import QUERIES
from tests.llm.conftest import DOCS, SF, VECTORS
from tests.llm.test_queries import WORD

LONG = 2**63 - 1


def plain_runs(words):
    """All maximal repetitions of at least six words and four periods, by every lag."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in found.items()], key=lambda r: (r[0], r[2]))


pieces = st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=7), st.integers(1, 9))
texts = st.lists(pieces, max_size=8).map(lambda ps: [x for unit, n in ps for x in unit * n])


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, min_size=1, max_size=3))
def test_runs_are_those_of_a_scan_of_all_lags(given_texts):
    got = periodic.runs_of([np.array(t, np.int64) for t in given_texts])
    assert got == [plain_runs(t) for t in given_texts]


@pytest.mark.parametrize("unit", [1, 2, 3, 97, 1000, 25_000])
def test_long_runs(unit):
    words = np.concatenate([[-1 % 10**6], np.tile(np.arange(unit), 100_000 // unit), [10**6]])
    assert periodic.runs_of([words.astype(np.int64)]) == [[(1, 100_000 // unit * unit, unit)]] or (
        unit == 1 and periodic.runs_of([words]) == [[(1, 100_000, 1)]]
    )


def test_split_leaves_no_rare_word():
    rng = random.Random(2)
    words = np.array([rng.choice([1, 1, 2, 2, 3, rng.randrange(50)]) for _ in range(3000)])
    left = periodic.split(words, np.zeros(3000, np.int64))
    for first, stop in left:
        assert stop - first >= 6 and min(Counter(words[first:stop].tolist()).values()) >= 4
    inside = {i for first, stop in left for i in range(first, stop)}
    assert all(set(range(s, s + n)) <= inside for s, n, _ in plain_runs(words.tolist()))


def contract_words(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_periodic_runs_of_documents(spark, odd, documents, which):
    given_docs = [d[:2] for d in DOCS] if which == "odd" else documents.items()
    want = Counter()
    for doc_id, text in given_docs:
        words = contract_words(doc_id, text)
        runs = [(0, len(words), 1)] if len(set(words)) == 1 and len(words) > 5 else plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        want[(doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
              hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())] += 1
    got = QUERIES["op13_periodic_runs"](spark, odd if which == "odd" else SF).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert Counter(tuple(r[c] for c in names) for r in got) == want


def test_collapsed_text_of_bytes_that_are_no_text(spark):
    rows = spark.sql("select 1L as doc_id, cast(repeat(x'ff20', 9) as string) as text, 'x' as runs")
    found = periodic.detect(rows).collect()
    assert [tuple(r) for r in found[0].runs] == [(0, 9, 1)]


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    place = hilbert.curve_place(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6), st.floats(0.0, 3.0))
def test_candidates_hold_every_nearest_centroid(seed, size, k, apart):
    rng = np.random.default_rng(seed)
    centroids = np.floor(rng.normal(size=(k, 5)) * 100 * apart)
    vectors = np.floor(centroids[rng.integers(0, k)] + rng.normal(size=(size, 5)) * 30)
    axes = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    turned = vectors @ axes
    left = hilbert.candidates(turned.min(axis=0), turned.max(axis=0), centroids @ axes)
    far = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
    assert set(far.argmin(axis=1).tolist()) <= set(left.tolist())


@pytest.mark.parametrize("value", [0, 1, -1, 2**60, -(2**60), 2**130 + 5, -(2**200) - 7])
def test_limbs(value):
    assert sum(part << hilbert.LIMB * i for i, part in enumerate(hilbert.limbs(value))) == value


def plain_clusters(vectors, k=8, rounds=10):
    kept = [
        (i, [math.floor(Fraction(float(np.float32(x))) * 1024) for x in v])
        for i, v in vectors
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()
                                        if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [
            [sum(x) // len(g) for x in zip(*g, strict=True)] if g else c
            for g, c in zip(groups, centroids, strict=True)
        ]
    last = [(i, *nearest(v)) for i, v in kept]
    own = Counter()
    for _, d, n in last:
        own[n] += d
    return Counter(
        (i, n, min(d, LONG), min(own[n], LONG), min(sum(own.values()), LONG),
         hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
        for i, d, n in last
    )


NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_of_odd_vectors(spark, odd):
    got = QUERIES["op11_centroid_clustering"](spark, odd).collect()
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == plain_clusters(VECTORS)


def test_fewer_vectors_than_centroids_and_copies(spark):
    rows = [(i, [0.1 * (i % 2)] * 64) for i in range(5)] + [(None, [0.1] * 64)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = hilbert.cluster(df, 8, 10, 64, salt="3:")
    got = hilbert.digest(found, df).collect()
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == plain_clusters(rows)


def test_clear_clusters_are_mostly_pruned_to_one_candidate(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(8, 64))
    vectors = middles[rng.integers(0, 8, 12_000)] + rng.normal(size=(12_000, 64)) * 0.05
    rows = [(i, v) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hilbert.cluster(df, 8, 3, 64, salt="3:")
    numbers = hilbert.as_numbers(found.centroids)
    left = []
    for batch in found.blocks.toArrow().to_batches():
        blocks = hilbert.Blocks(batch, numbers, found.frame)
        left += [len(blocks.candidates(i)) for i in blocks]
    assert sum(found.members) == 12_000
    assert sum(n == 1 for n in left) > len(left) / 2


def test_noisy_or_of_sentences():
    words = ["bad", "ba*", "bad*", "so*", "other"]
    keys = {w: xxhash.xxh64_intdigest(w) for w in words[:4]}
    weight = {"bad": 2.0, "ba*": 9.0, "bad*": 1.5, "so*": 9.0}
    order = sorted(keys, key=keys.get)
    model = toxicity.Model(
        np.array([keys[w] for w in order], np.uint64), np.array([weight[w] for w in order]), -3.0
    )
    texts = ["Bad, bad day. A good one!\nBadly", "", "... !", "no 3.5 e.g. x"]
    found = toxicity.bags(texts)
    logits = toxicity.chances(found, toxicity.Weigher(model))
    assert found.owner.tolist() == [0, 0, 0, 3, 3]
    assert np.allclose(logits, [0.5, -3, -1.5, -3, -3])
    clean = [1 - 1 / (1 + math.exp(-x)) for x in logits]
    got = toxicity.noisy_or(logits, found.owner, 4)
    assert np.allclose(got, [1 - math.prod(clean[:3]), 0, 0, 1 - math.prod(clean[3:])])
    assert [texts[0][a:b] for a, b in toxicity.spans(texts[0])] == ["Bad, bad day.", "A good one!", "Badly"]


def test_gradient_is_that_of_the_noisy_or():
    """One step from zero moves each weight against the numeric gradient."""
    rows = [(np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2]), 3, label) for label in (0, 1)]

    def loss(w, label):
        logits = np.bincount(rows[0][0], w[rows[0][1]], 3) + w[3] + toxicity.CLEAN
        p = toxicity.noisy_or(logits, np.zeros(3, int), 1)[0]
        return -math.log(p if label else 1 - p)

    for row in rows:
        step = toxicity.learn([row], 3, turns=1)
        numeric = [
            (loss(1e-5 * e, row[3]) - loss(-1e-5 * e, row[3])) / 2e-5 for e in np.eye(4)
        ]
        for moved, slope in zip(step, numeric, strict=True):
            assert abs(slope) <= toxicity.L1 + 1e-6 and moved == 0 or moved * slope < 0


def toxic_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = toxic_rows(spark, "/root/testdata/sf0.1")
    return docs, labels, toxicity.train(docs, labels)


def test_toxic_documents_not_learned_are_found(spark, learned):
    docs, labels, model = learned
    got = toxicity.score(docs, model).join(labels.groupBy("doc_id").max("toxic"), "doc_id")
    held = [(r["max(toxic)"], r.predicted) for r in got.filter("held_out").collect()]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert len(toxic) > 50 and sum(toxic) > 0.8 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_offending_sentences_are_located(spark, learned):
    docs, _, model = learned
    few = docs.filter("lang = 'en'").limit(600)
    texts = {r.doc_id: r.text for r in few.collect()}
    found = toxicity.locate(few, model).collect()
    marks = ("idiot", "clown", "scum", "worthless", "trash", "pathetic", "moron", "loser", "stupid", "disgusting")
    assert found and all(texts[r.doc_id][r.start : r.start + r.length] == r.text for r in found)
    assert sum(any(m in r.text.lower() for m in marks) for r in found) > 0.9 * len(found)
    counts = Counter(r.doc_id for r in found)
    scored = toxicity.score(few, model).filter("n_offending > 0").collect()
    assert counts == {r.doc_id: r.n_offending for r in scored}


def test_toxicity_contract_columns(spark, odd):
    for folder in (SF, odd):
        for r in QUERIES["op12_toxicity"](spark, folder).collect():
            held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_no_labels_and_one_kind_of_label(spark, odd):
    docs, _ = toxic_rows(spark, odd)
    for rows in ([], [(5, 0), (3, 0), (None, 1), (12, 0)], [(5, 1), (3, 1)], [(99, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
        assert all(r.score == 0 for r in got if r.n_sentences == 0)


def test_the_sample_keeps_to_its_bounds(spark):
    docs, labels = toxic_rows(spark, SF)
    sample = toxicity.sample_of(docs, labels, 40, 60_000).collect()
    assert 0 < len(sample) <= 40 and sum(len((r.text or "").encode()) for r in sample) <= 60_000
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)
