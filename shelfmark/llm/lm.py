"""Interpolated modified Kneser-Ney word pairs, counted in Spark, scored from mapped arrays.

Texts are lower-cased words and an end; the first word's context is a start. Counting
goes in three steps, each of them numbers packed by shard and summed in shards:

1. words: how often each occurs in training texts;
2. pairs: how often each occurs, sharded by the first word. A first word that is more
   than about a thousandth of all tokens is spread over the shards by the pair. Shards
   write their pairs as sorted arrays of hashes with counts, and report what each first
   word has (tokens, pairs seen once, twice, more often) and how many different first
   words each word follows;
3. those reports, summed for each word, next to its count.

The arrays lie in the shared folder. Scoring tasks map them into memory, look up the
different words and pairs of a chunk in sorted order, and keep only those pages that they
touch. The folder must be mounted on every machine; mapping needs a path, not a store.

Pairs keep discounts for counts of one, two and three or more, estimated from the counts
of counts; the words' own distribution is over the numbers of words they follow, with
discounts of its own, and what these leave goes evenly to all words and one unknown.

Defined cases: a null text is empty and has the end as its only token; a document without
an id trains and is not held out; repeated rows count each time; with nothing to train
on every text scores 0 (one unknown word, certain); words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import PACKED, chunks, mix, pack_by, shards_for, unpack_all, utf8
from shelfmark.sources.shared import new_table_path, settle

START, END = np.uint64(1), np.uint64(2)
CHUNK = 6_000_000
SHARD_BYTES = 16_000_000
FOLDS, HELD_OUT = 5, 1
PAIR = np.uint64(0x9FB21C651E98DF25)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, each text's followed by END; tokens of each text."""
    number: dict[bytes, int] = {}
    at: list[int] = []
    sizes = []
    for raw in texts:
        words = raw.lower().split()
        at += [number.setdefault(w, len(number)) for w in words]
        at.append(-1)
        sizes.append(len(words) + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in number), np.uint64, len(number))
    hashes = np.append(np.maximum(hashes, np.uint64(3)), END)  # 1 and 2 are taken
    return hashes[np.array(at, np.int64)], np.array(sizes, np.int64)


def contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each, START before the first of a text."""
    before = np.r_[START, words[:-1]] if len(words) else words
    before[np.cumsum(sizes) - sizes] = START
    return before


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * PAIR + second)


def grouped_sum(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of the columns over each."""
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    sums = [np.add.reduceat(c[order].astype(np.int64), head) if len(keys) else c for c in columns]
    return (keys[head], *sums)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) % np.uint64(shards)).astype(np.int32)


def training(part: pa.RecordBatch) -> list[bytes]:
    ids = part.column("doc_id").to_pylist()
    texts = utf8(part.column("text"))
    return [x for i, x in zip(ids, texts, strict=True) if not is_held_out(i)]


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array so that it is there whole or not at all; a repeated task may rewrite it."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{os.getpid()}.npy"
    np.save(part, values)
    os.replace(part, f"{folder}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def mounted(path: str) -> str:
    """The path of a folder that is named with the scheme ``file`` or none."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the model's arrays are mapped from a mounted folder, not from {path}")
    return parsed.path


def count_words(docs: DataFrame, shards: int, folder: str, hot: int) -> DataFrame:
    """Step 1: each shard writes its words and counts; tokens, types and hot words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            words, _ = word_numbers(training(part))
            if len(words):
                word, n = np.unique(words, return_counts=True)
                yield pack_by(shard_of(word, shards), {"word": word, "n": n.astype(np.int32)})

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = unpack_all(group.column("payload"))
        word, n = grouped_sum(rows.column("word").to_numpy(), rows.column("n").to_numpy())
        save(folder, f"word-{key[0].as_py()}", word)
        save(folder, f"count-{key[0].as_py()}", n)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()),
            "tokens": pa.array([int(n.sum())]), "types": pa.array([len(n)]),
            "hot": pa.array([word[n > hot].view(np.int64).tolist()], pa.list_(pa.int64())),
        })

    return docs.mapInArrow(send, PACKED).groupBy("shard").applyInArrow(
        add, "shard int, tokens long, types long, hot array<long>"
    )


def count_pairs(docs: DataFrame, shards: int, folder: str, hot: np.ndarray) -> DataFrame:
    """Step 2: each shard writes its pairs; kind 0: counts of counts, 1: words' reports."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            second, sizes = word_numbers(training(part))
            if not len(second):
                continue
            first = contexts(second, sizes)
            key = pair_hash(first, second)
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            first, second, key = first[at], second[at], key[at]
            spread = np.isin(first, hot)
            shard = np.where(spread, key % np.uint64(shards), mix(first) % np.uint64(shards))
            order = np.argsort(first, kind="stable")  # equal first words together pack well
            yield pack_by(shard[order].astype(np.int32), {
                "first": first[order], "second": second[order], "n": n[order].astype(np.int32),
            })

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = unpack_all(group.column("payload"))
        first, second, n = (rows.column(c).to_numpy() for c in ("first", "second", "n"))
        hashes = pair_hash(first, second)
        order = np.argsort(hashes)
        hashes, first, second, n = hashes[order], first[order], second[order], n[order]
        head = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        n = np.add.reduceat(n.astype(np.int64), head)
        hashes, first, second = hashes[head], first[head], second[head]
        save(folder, f"pair-{key[0].as_py()}", hashes)
        save(folder, f"pair-count-{key[0].as_py()}", np.minimum(n, 2**32 - 1).astype(np.uint32))
        one = np.ones(len(n), np.int64)
        left = grouped_sum(first, n, n == 1, n == 2, n > 2)
        right = grouped_sum(second, one)
        none = np.zeros
        word = np.r_[left[0], right[0]]
        columns = {"word": word}
        for i, name in enumerate(("total", "one", "two", "more")):
            columns[name] = np.r_[left[1 + i], none(len(right[0]), np.int64)]
        columns["after"] = np.r_[none(len(left[0]), np.int64), right[1]]
        report = pack_by(shard_of(word, shards), columns)
        kinds = pa.array([1] * report.num_rows, pa.int32())
        counts = pa.array([None] * report.num_rows, pa.list_(pa.int64()))
        reports = pa.table({
            "kind": kinds, "shard": report.column(0), "payload": report.column(1), "counts": counts,
        })
        totals = pa.table({
            "kind": pa.array([0], pa.int32()), "shard": pa.array([0], pa.int32()),
            "payload": pa.array([None], pa.binary()),
            "counts": pa.array([[int((n == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())),
        })
        return pa.concat_tables([reports, totals])

    return docs.mapInArrow(send, PACKED).groupBy("shard").applyInArrow(
        add, f"kind int, {PACKED}, counts array<long>"
    )


def add_reports(reports: DataFrame, folder: str) -> DataFrame:
    """Step 3: each shard writes its words' sums; counts of ``after``, their total."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = unpack_all(group.column("payload"))
        names = ("total", "one", "two", "more", "after")
        word, *sums = grouped_sum(
            rows.column("word").to_numpy(), *(rows.column(c).to_numpy() for c in names)
        )
        shard = key[0].as_py()
        save(folder, f"known-{shard}", word)
        save(folder, f"known-sums-{shard}", np.stack(sums, axis=1).astype(np.int64))
        after = sums[-1]
        counts = [int((after == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({
            "counts": pa.array([counts], pa.list_(pa.int64())),
            "types": pa.array([int((after > 0).sum())]), "total": pa.array([int(after.sum())]),
        })

    return reports.groupBy("shard").applyInArrow(
        add, "counts array<long>, types long, total long"
    )


def discounts(counts: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from how many have counts 1 to 4."""
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [0.0]
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        value = k - (k + 1) * y * high / low if low else k / 2
        found.append(min(max(value, 0.05), k - 0.05))
    return np.array(found)


def look_up(folder: str, name: str, keys: np.ndarray, shard: np.ndarray, values: str):
    """For sorted groups of keys by shard: where found, and the rows of ``values`` there."""
    found = np.zeros(len(keys), bool)
    rows = None
    order = np.lexsort((keys, shard))
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        own = f"{int(shard[part[0]])}"
        if not os.path.exists(f"{folder}/{name}-{own}.npy"):
            continue
        held, data = load(folder, f"{name}-{own}"), load(folder, f"{values}-{own}")
        at = np.minimum(np.searchsorted(held, keys[part]), max(len(held) - 1, 0))
        hit = held[at] == keys[part] if len(held) else np.zeros(len(part), bool)
        if rows is None:
            rows = np.zeros((len(keys), *data.shape[1:]), np.int64)
        found[part[hit]] = True
        rows[part[hit]] = data[at[hit]]
    return found, rows


def score(docs: DataFrame) -> DataFrame:
    """Base and model scores of each row of ``docs`` (doc_id, text).

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards_for(size, SHARD_BYTES)
    folder = mounted(new_table_path(docs.sparkSession, "kneser-ney"))
    found = count_words(docs, shards, folder, size // 6000).collect()
    tokens, types = (sum(r[c] for r in found) for c in ("tokens", "types"))
    hot = [w for r in found for w in r.hot]
    hot = np.array([*hot, int(START)], np.int64).view(np.uint64)
    reports = count_pairs(docs, shards, folder, hot)
    reports = settle(reports, "pair_reports")
    counts = reports.filter("kind = 0").select("counts").collect()
    pair_off = discounts([sum(r.counts[k] for r in counts) for k in range(4)])
    sums = add_reports(reports.filter("kind = 1"), folder).collect()
    word_off = discounts([sum(r.counts[k] for r in sums) for k in range(4)])
    followed = sum(r.total for r in sums)
    seen = [sum(r.counts[k] for r in sums) for k in (0, 1)]
    many = sum(r.types for r in sums) - sum(seen)
    spare = (word_off[1:] * [*seen, many]).sum() / followed if followed else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            ids = part.column("doc_id").to_pylist()
            second, sizes = word_numbers(utf8(part.column("text")))
            first = contexts(second, sizes)
            word, at = np.unique(second, return_inverse=True)
            known, n = look_up(folder, "word", word, shard_of(word, shards), "count")
            n = np.zeros(len(word), np.int64) if n is None else n
            both = np.unique(np.r_[word, START])
            _, held = look_up(folder, "known", both, shard_of(both, shards), "known-sums")
            held = np.zeros((len(both), 5), np.int64) if held is None else held
            after = held[np.searchsorted(both, second), 4]
            base = np.log10((n[at] + 0.5) / (tokens + 0.5 * (types + 1)))
            alone = (after - word_off[np.minimum(after, 3)]) / max(followed, 1)
            alone = alone + spare / (types + 1)
            key = pair_hash(first, second)
            pair, one_at, back = np.unique(key, return_index=True, return_inverse=True)
            lead = first[one_at]
            spread = np.isin(lead, hot)
            shard = np.where(spread, pair % np.uint64(shards), mix(lead) % np.uint64(shards))
            _, times = look_up(folder, "pair", pair, shard.astype(np.int64), "pair-count")
            times = (np.zeros(len(pair), np.int64) if times is None else times)[back]
            context = held[np.searchsorted(both, first)]
            total = np.maximum(context[:, 0], 1)
            left = np.where(context[:, 0] > 0, context[:, 1:4] @ pair_off[1:] / total, 1.0)
            likely = (times - pair_off[np.minimum(times, 3)]) / total + left * alone
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total_of = lambda x: np.bincount(owner, x, len(sizes))
            log = total_of(np.log10(likely))
            yield pa.record_batch({
                "doc_id": part.column("doc_id"),
                "held_out": pa.array([is_held_out(i) for i in ids]),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(total_of(known[at]).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(sizes), tokens, np.int64)),
                "base_score": pa.array(total_of(base)), "score": pa.array(log),
                "perplexity": pa.array(10 ** np.minimum(-log / sizes, 300)),
            })

    return docs.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, perplexity double",
    )
