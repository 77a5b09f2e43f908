"""Toxic sentences found by learning from documents' labels alone.

A document is a bag of sentences, toxic if one of them is. A sentence's chance is a
logistic function of its words, their first ``STEMS`` letters and its word pairs (lower-cased;
a word or pair counts once), and a document's is the noisy-or of its sentences: one minus
the product of their chances of being clean. Its gradient blames, in a toxic document, the
sentences that look worst already, and in a clean one all of them, so labels of documents
train sentences. Weights follow the regularised leader, a document at a time. Only features
of ``SEEN_IN`` or more training documents are learned, and those that toxic ones have more
often than chance by ``DEVIATIONS`` standard deviations, since others tell nothing and
would make long texts look worse. Stems let parts of words that recur count, whatever the
ending.

The sample is bounded: the first ``SAMPLE`` labelled documents in the order of a hash of
their ids, those of fold 0 of five left out, up to ``SAMPLE_BYTES`` of text. Everything
else covers all documents and whole texts, and needs no shuffle.

Defined cases: a null or empty text, or one without a word, has no sentence and the score
0; without labelled rows all scores are 0; a document with several labels is learned once,
with the highest, and of several texts of one id the least; repeated rows have equal
scores; a document without an id is scored but not learned; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, mix, utf8

SAMPLE, SAMPLE_BYTES = 6000, 16_000_000
FOLDS, HELD_OUT = 5, 0
PREDICT_FROM = 0.5
SEEN_IN, DEVIATIONS = 3, 2.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.01
TURNS = 20
#: Where the bias starts: a sentence is clean unless something speaks against it.
CLEAN = -5.0
#: Lengths of the beginnings of words that are features.
STEMS = (3, 4, 5, 6)
REMEMBERED = 300_000
ENDS = ".!?…。！？\n"
TOKEN = re.compile(r"[^\W_]+|[.!?…。！？]+(?=\s|$)|\n+")
PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Keys of the words and pairs that count, ascending, their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)


@dataclass(frozen=True)
class Bags:
    """Sentences of texts laid end to end, with the words and pairs of each, repeats included."""

    owner: np.ndarray
    words: list[str]
    sentence: np.ndarray
    word: np.ndarray
    pair_sentence: np.ndarray
    pair: np.ndarray


def bags(texts: list[str]) -> Bags:
    number: dict[str, int] = {}
    at: list[int] = []
    sizes = []
    for text in texts:
        found = TOKEN.findall(text.lower())
        at += [number.setdefault(t, len(number)) for t in found]
        sizes.append(len(found))
    words = list(number)
    token = np.array(at, np.int64)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    end = np.fromiter((t[0] in ENDS for t in words), bool, len(words))[token]
    group = np.cumsum(end) + text_of
    word, group, text_of = token[~end], group[~end], text_of[~end]
    first = np.concatenate((np.ones(min(1, len(group)), bool), np.diff(group) != 0))
    sentence = np.cumsum(first) - 1
    inner = ~first[1:]
    digest = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    pair = mix(mix(digest ^ PAIR)[word[:-1][inner]] + digest[word[1:][inner]])
    return Bags(text_of[first], words, sentence, word, sentence[1:][inner], pair)


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word and its stems, and the number of the word of each key.

    Words share stems, so those of equal beginnings are made once.
    """
    digest = xxhash.xxh64_intdigest
    stems: dict[str, list[int]] = {}
    keys: list[int] = []
    many = []
    for word in words:
        begin = word[: STEMS[-1]]
        of = stems.get(begin)
        if of is None:
            of = stems[begin] = [digest(begin[:n] + "*") for n in STEMS if n <= len(begin)]
        keys.append(digest(word))
        keys += of
        many.append(1 + len(of))
    return np.array(keys, np.uint64), np.repeat(np.arange(len(words)), many)


def distinct(group: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two small numbers, by the first."""
    both = np.unique(group << 32 | number)
    return both >> 32, both & 0xFFFFFFFF


def places(key: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``key`` are in the ascending ``keys``, and where those are."""
    place = np.searchsorted(keys, key)
    place[place == len(keys)] = 0
    hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
    return hit, place[hit]


class Weigher:
    """Weights of words with their stems, remembered for up to ``REMEMBERED`` words."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, float] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = [w for w in words if w not in self.seen]
        key, of = word_keys(new)
        hit, place = places(key, self.model.keys)
        weight = np.bincount(of[hit], self.model.weights[place], len(new))
        self.seen.update(zip(new, weight.tolist(), strict=True))
        return np.fromiter(map(self.seen.__getitem__, words), float, len(words))


def chances(found: Bags, weigher: Weigher) -> np.ndarray:
    """Each sentence's chance of being toxic, as a logit."""
    model, weight = weigher.model, weigher(found.words)
    some = weight[found.word] != 0
    sentence, word = distinct(found.sentence[some], found.word[some])
    sentences = len(found.owner)
    logits = np.bincount(sentence, weight[word], sentences) + model.bias
    hit, place = places(found.pair, model.keys)
    sentence, place = distinct(found.pair_sentence[hit], place)
    return logits + np.bincount(sentence, model.weights[place], sentences)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def noisy_or(logits: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Each text's chance that not all of its sentences are clean."""
    if not len(logits):
        return np.zeros(texts)
    return -np.expm1(-np.bincount(owner, np.logaddexp(0, logits), texts))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int, int]], size: int, turns: int = TURNS):
    """Weights of ``size`` features, the bias last, after FTRL over documents.

    A row is (sentence, feature) of each pair, the number of sentences and the label.
    """
    total, seen = np.zeros(size + 1), np.zeros(size + 1)
    ready = []
    for sentence, feature, many, label in rows:
        if many:
            used, back = np.unique(feature, return_inverse=True)
            ready.append((sentence, np.append(used, size), back, many, label))
    for _ in range(turns):
        for sentence, used, back, many, label in ready:
            w = weights_of(total[used], seen[used])
            logits = np.bincount(sentence, w[:-1][back], many) + w[-1] + CLEAN
            blame = logistic(logits)
            if label:
                clean = np.exp(-np.logaddexp(0, logits).sum())
                blame *= -clean / max(1 - clean, 1e-12)
            g = np.append(np.bincount(back, blame[sentence], len(used) - 1), blame.sum())
            more = seen[used] + g * g
            total[used] += g - (np.sqrt(more) - np.sqrt(seen[used])) / ALPHA * w
            seen[used] = more
    return weights_of(total, seen)


def weights_of(total: np.ndarray, seen: np.ndarray) -> np.ndarray:
    shrunk = np.sign(total) * L1 - total
    return np.where(np.abs(total) > L1, shrunk / ((BETA + np.sqrt(seen)) / ALPHA + L2), 0.0)


def fit(texts: list[str], labels: list[int], seen_in: int) -> Model:
    """A model from whole documents and their labels."""
    found = bags(texts)
    key, of = word_keys(found.words)
    start = np.searchsorted(of, np.arange(len(found.words) + 1))
    document, word = distinct(found.owner[found.sentence], found.word)
    entry, at = expand(word, start)
    keys = telling(
        np.concatenate((document[at], found.owner[found.pair_sentence])),
        np.concatenate((key[entry], found.pair)), np.array(labels), seen_in,
    )
    hit, place = places(key, keys)
    of, start = of[hit], np.searchsorted(of[hit], np.arange(len(found.words) + 1))
    sentence, word = distinct(found.sentence, found.word)
    entry, at = expand(word, start)
    hit, pair_place = places(found.pair, keys)
    pair_sentence, pair_place = distinct(found.pair_sentence[hit], pair_place)
    sentence = np.concatenate((sentence[at], pair_sentence))
    feature = np.concatenate((place[entry], pair_place)).astype(np.int32)
    order = np.argsort(sentence, kind="stable")
    sentence, feature = sentence[order], feature[order]
    first = np.searchsorted(found.owner, np.arange(len(texts) + 1))
    cut = np.searchsorted(sentence, first)
    rows = [
        (sentence[cut[i] : cut[i + 1]] - first[i], feature[cut[i] : cut[i + 1]],
         int(first[i + 1] - first[i]), label)
        for i, label in enumerate(labels)
    ]
    weights = learn(rows, len(keys))
    used = np.flatnonzero(weights[:-1])
    return Model(keys[used], weights[used], float(weights[-1] + CLEAN))


def expand(word: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``start[w]`` up to ``start[w + 1]`` of each word, and which word each is of."""
    many = start[word + 1] - start[word]
    at = np.repeat(np.arange(len(word)), many)
    within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return start[word][at] + within, at


def telling(document: np.ndarray, key: np.ndarray, labels: np.ndarray, least: int) -> np.ndarray:
    """Ascending keys of at least so many documents, with more toxic ones than by chance."""
    order = np.lexsort((document, key))
    key, document = key[order], document[order]
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(document) != 0) | (key[1:] != key[:-1])
    keys, back, often = np.unique(key[new], return_inverse=True, return_counts=True)
    toxic = np.bincount(back, labels[document[new]], len(keys))
    rate = labels.mean() if len(labels) else 0.0
    chance = np.sqrt(often * rate * (1 - rate))
    return keys[(often >= least) & (toxic - often * rate > DEVIATIONS * chance)]


def sample_of(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """doc_id, text, toxic, place of the training documents, within both bounds."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").filter(fold != HELD_OUT)
    chosen = (
        marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    )
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows
        .groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    )
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "place")
    upto = Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = sizes.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= sample_bytes)
    return texts.join(F.broadcast(within.select("doc_id")), "doc_id")


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
    seen_in: int = SEEN_IN,
) -> Model:
    """The model, learned in one task from the bounded sample."""

    def learned(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        texts = [t.decode("utf-8", "replace") for t in utf8(group.column("text").combine_chunks())]
        model = fit(texts, group.column("toxic").to_pylist(), seen_in)
        return pa.table({
            "keys": pa.array([model.keys.tobytes()], pa.binary()),
            "weights": pa.array([model.weights.tobytes()], pa.binary()),
            "bias": [model.bias],
        })

    rows = sample_of(docs, labels, sample, sample_bytes).select("text", "toxic", "place")
    found = (
        rows.withColumn("all", F.lit(0)).groupBy("all")
        .applyInArrow(learned, "keys binary, weights binary, bias double").collect()
    )
    if not found:
        return NOTHING
    row = found[0]
    return Model(np.frombuffer(row.keys, np.uint64), np.frombuffer(row.weights), row.bias)


def score(docs: DataFrame, model: Model, predict_from: float = PREDICT_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, n_offending of each document.

    A sentence offends if its own chance reaches ``predict_from``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(model)
        for part in chunks(batches, "text"):
            found = bags([t.decode("utf-8", "replace") for t in utf8(part.column("text"))])
            logits, texts = chances(found, weigher), part.num_rows
            p = noisy_or(logits, found.owner, texts)
            held = [
                i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT
                for i in part.column("doc_id").to_pylist()
            ]
            worst = logistic(logits) >= predict_from
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "held_out": pa.array(held), "score": pa.array(p),
                "predicted": pa.array((p >= predict_from).astype(np.int32)),
                "n_sentences": pa.array(np.bincount(found.owner, minlength=texts)),
                "n_offending": pa.array(np.bincount(found.owner[worst], minlength=texts)),
            })

    schema = (
        "doc_id long, held_out boolean, score double, predicted int, n_sentences long, "
        "n_offending long"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def locate(docs: DataFrame, model: Model, at_least: float = PREDICT_FROM) -> DataFrame:
    """The offending sentences: doc_id, number, start and length in characters, score, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(model)
        for part in chunks(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            texts = [t.decode("utf-8", "replace") for t in utf8(part.column("text"))]
            found = bags(texts)
            p = logistic(chances(found, weigher))
            first = np.searchsorted(found.owner, np.arange(len(texts)))
            out = []
            for text in np.unique(found.owner[p >= at_least]).tolist():
                for i, (start, stop) in enumerate(spans(texts[text])):
                    chance = float(p[first[text] + i])
                    if chance >= at_least:
                        inside = texts[text][start:stop]
                        out.append((ids[text], i, start, stop - start, chance, inside))
            columns = zip(*out, strict=True) if out else ((),) * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
    names = ["doc_id", "sentence", "start", "length", "score", "text"]
    schema = "doc_id long, sentence long, start long, length long, score double, text string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence with a word, closing marks included."""
    found: list[tuple[int, int]] = []
    begin = stop = None
    for token in TOKEN.finditer(text):
        if token[0][0] not in ENDS:
            begin, stop = token.start() if begin is None else begin, token.end()
        elif begin is not None:
            found.append((begin, stop if token[0][0] == "\n" else token.end()))
            begin = None
    return found if begin is None else [*found, (begin, stop)]
