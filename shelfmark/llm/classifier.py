"""A quality score: logistic regression over hashed word n-grams, learned by FTRL.

Features are one and two words in a row, as written (A-Z lower-cased) and as shapes
(letter case, digits and marks, runs shortened; a word equal to the one before it is a
shape of its own), hashed into ``2 ** BITS`` weights. A feature's value is one plus the
logarithm of its count, and a document's values have length one. Weights follow the
regularised leader, one document at a time: the first ``SAMPLE`` labelled documents in
the order of a hash of their ids, those of fold 0 of five left out. Scores are sparse
dot products, for whole texts.

Defined cases: a null or empty text has no features and the score of the bias; without
labelled rows all scores are 0.5; a document with several labels is learned once, with
the highest; repeated rows have equal scores; a document without an id is not learned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, mix, utf8

BITS = 18
SAMPLE = 6000
FOLDS, HELD_OUT = 5, 0
PREDICT_FROM = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.5
TURNS = 8
SAME = np.uint64(0x5851F42D4C957F2D)
STREAMS = [np.uint64(x) for x in (11, 13, 17, 19)]
SHAPES = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128
    else ord("0") if 48 <= c <= 57 else c for c in range(256)
)
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all texts end to end, their values, and each text's number of them."""
    number: dict[bytes, int] = {}
    at: list[int] = []
    sizes = []
    for raw in texts:
        words = raw.split()
        at += [number.setdefault(w, len(number)) for w in words]
        sizes.append(len(words))
    digest = xxhash.xxh64_intdigest
    written = np.fromiter((digest(w.lower()) for w in number), np.uint64, len(number))
    shape: dict[bytes, int] = {}
    for w in number:
        shape.setdefault(w.translate(SHAPES), 0)
    shape = {w: digest(RUNS.sub(rb"\1", w)) for w in shape}
    shapes = np.fromiter((shape[w.translate(SHAPES)] for w in number), np.uint64, len(number))
    word, sizes = np.array(at, np.int64), np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = owner[1:] == owner[:-1]
    surface, form = written[word], shapes[word]
    form[1:][inner & (word[1:] == word[:-1])] = SAME
    keys, docs = [], []
    for values, one, two in ((surface, *STREAMS[:2]), (form, *STREAMS[2:])):
        keys += [mix(values ^ one), mix(mix(values[:-1][inner] ^ two) + values[1:][inner])]
        docs += [owner, owner[1:][inner]]
    slot = (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)
    both, count = np.unique(np.concatenate(docs) << BITS | slot, return_counts=True)
    owner, slot = both >> BITS, both & ((1 << BITS) - 1)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, value * value, len(sizes)))
    return slot, value / norm[owner], np.bincount(owner, minlength=len(sizes))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], turns: int = TURNS) -> np.ndarray:
    """Weights after FTRL over (features, values, label); the last weight is the bias.

    Both labels weigh the same in all, however rare one is, so that a score says which
    is likelier by the text and not by how many there are.
    """
    size = (1 << BITS) + 1
    many = [max(1, sum(label == k for *_, label in rows)) for k in (0, 1)]
    share = [len(rows) / (2 * n) for n in many]
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(turns):
        for slot, value, label in rows:
            slot, value = np.append(slot, size - 1), np.append(value, 1.0)
            w = weights_of(z[slot], n[slot])
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = share[label] * (p - label) * value
            more = n[slot] + g * g
            z[slot] += g - (np.sqrt(more) - np.sqrt(n[slot])) / ALPHA * w
            n[slot] = more
    return weights_of(z, n).astype(np.float32)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) > L1, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The weights, learned in one task from ``sample`` rows at most."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    chosen = (
        labels.filter("doc_id is not null and quality in (0, 1)").filter(fold != HELD_OUT)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            slot, value, many = features(utf8(part.column("text")))
            cuts = np.cumsum(many)[:-1]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "quality": part.column("quality"),
                "slots": pa.array([x.astype("<i4").tobytes() for x in np.split(slot, cuts)], pa.binary()),
                "amounts": pa.array([x.astype("<f4").tobytes() for x in np.split(value, cuts)], pa.binary()),
            })

    def fit(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(mix(group.column("doc_id").to_numpy().view(np.uint64)))))
        rows = [
            (np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4").astype(float), q)
            for s, v, q in zip(*(group.column(c).to_pylist() for c in ("slots", "amounts", "quality")), strict=True)
        ]
        return pa.table({"weights": pa.array([learn(rows).tobytes()], pa.binary())})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows
    rows = rows.mapInArrow(sparse, "doc_id long, quality int, slots binary, amounts binary")
    rows = rows.dropDuplicates(["doc_id"])
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "weights binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.frombuffer(found[0].weights, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            slot, value, many = features(utf8(part.column("text")))
            owner = np.repeat(np.arange(len(many)), many)
            dot = np.bincount(owner, weights[slot] * value, len(many)) + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            held = [
                i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT
                for i in part.column("doc_id").to_pylist()
            ]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "held_out": pa.array(held), "score": pa.array(p),
                "predicted": pa.array((p >= PREDICT_FROM).astype(np.int32)),
            })

    schema = "doc_id long, held_out boolean, score double, predicted int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
