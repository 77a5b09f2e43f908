"""Runs of words that repeat with a period, found by splitting on rare words.

The words of a text are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest
period q and at least ``max(6, 4 * q)`` words, which no neighbour extends. So each of its
words occurs four times in it: a word that occurs less often within its segment is in no
run there and splits the segment. Segments are counted and split again until none
changes; those of fewer than six words go.

What is left is scanned by lags, those from 2^k to 2^(k+1) together: a run of such a period
holds at least two blocks of 2^k words, at multiples of 2^k, that are equal at the lag.
Blocks are compared by exact names, each level's names being pairs of the one below, so a
segment of n words costs n comparisons and one sort a level. Stretches of equal
blocks are extended word by word to their ends. A stretch inside a known run of a smaller
period repeats that run and is left out.

Defined cases: a null, empty or blank text has no words and no runs; a document without
an id is scanned like any other; repeated rows have equal results; other columns are left
out; a text is scanned whole, in memory that grows with its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, utf8

#: A run has at least so many words, and so many periods.
WORDS, PERIODS = 6, 4

Run = tuple[int, int, int]


def split(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """The segments left of texts laid end to end, as first place and the one after the last.

    ``words`` are numbers of words, ``owner`` the number of each one's text. Only segments
    that lost a word are counted again.
    """
    many = int(words.max(initial=0)) + 1
    place, segment = np.arange(len(words)), owner
    settled: list[tuple[int, int]] = []
    while len(place):
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(segment) != 0)) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.append(first, len(place)))
        segment = np.repeat(np.arange(len(first)), size)
        _, which, count = np.unique(
            segment * many + words[place], return_inverse=True, return_counts=True
        )
        rare = count[which] < PERIODS
        long = size >= WORDS
        whole = long & (np.bincount(segment, rare, len(first)) == 0)
        settled += zip(
            place[first[whole]].tolist(), (place[first[whole]] + size[whole]).tolist(), strict=True
        )
        go_on = ~rare & (long & ~whole)[segment]
        place, segment = place[go_on], segment[go_on]
    return settled


def scan(words: np.ndarray) -> list[Run]:
    """All runs of one segment as start, length, period."""
    found: list[Run] = []
    total, block, names = len(words), 1, np.unique(words, return_inverse=True)[1]
    while PERIODS * block <= total:
        starts = np.array(sorted(r[:2] for r in found), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(starts.sum(axis=1)) if found else None
        for lag, left, right in equal_blocks(names, block):
            if found:
                before = np.searchsorted(starts[:, 0], left, side="right")
                if before and reach[before - 1] >= right + lag:
                    continue
            left, right = extend(words, lag, left, right, block)
            if right - left + lag >= max(WORDS, PERIODS * lag):
                found.append((left, right - left + lag, lag))
        if len(names) <= block or names.max() + 1 == len(names):
            break  # no two blocks are equal, so no larger ones are
        pairs = names[:-block] * (names.max() + 1) + names[block:]
        names = np.unique(pairs, return_inverse=True)[1]
        block *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def equal_blocks(names: np.ndarray, block: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of blocks, at multiples of ``block``, equal to those a lag later.

    Gives lag, first place and the place after the last, for the lags from ``block`` to
    twice that, where the stretch can belong to a run of this lag.
    """
    anchors = names[::block]
    rows = len(anchors)
    later = np.full((rows + 1) * block, -1, np.int64)
    later[: len(names)] = names
    equal = anchors[:, None] == later[block:].reshape(rows, block)
    padded = np.zeros((block, rows + 2), bool)
    padded[:, 1:-1] = equal.T
    edges = np.flatnonzero(np.diff(padded.ravel().view(np.int8)))
    first, last = edges[::2], edges[1::2]
    column, row = np.divmod(first, rows + 2)
    lag, length = block + column, (last - first) * block
    least = np.maximum(WORDS, PERIODS * lag) - lag
    can = length + 2 * (block - 1) >= least
    left = row[can] * block
    yield from zip(lag[can].tolist(), left.tolist(), (left + length[can]).tolist(), strict=True)


def extend(words: np.ndarray, lag: int, left: int, right: int, most: int) -> tuple[int, int]:
    """The ends of the stretch of places whose word is that of ``lag`` places later."""
    low = max(0, left - most)
    differ = np.flatnonzero(words[low:left] != words[low + lag : left + lag])
    left = low + int(differ[-1]) + 1 if len(differ) else low
    high = min(len(words) - lag, right + most)
    differ = np.flatnonzero(words[right:high] != words[right + lag : high + lag])
    return left, right + int(differ[0]) if len(differ) else high


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each text, given as numbers of its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate([np.zeros(0, np.int64), *texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    found: list[list[Run]] = [[] for _ in texts]
    for first, stop in sorted(split(words, owner)):
        text = int(owner[first])
        shift = first - int(starts[text])
        found[text] += [(shift + s, n, q) for s, n, q in scan(words[first:stop])]
    return found


def repeated(size: int, runs: list[Run]) -> np.ndarray:
    """Which words come after the first period of a run that contains them."""
    change = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def detect(
    docs: DataFrame, alter: Callable[[int | None, np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """doc_id, runs (start, length, period by start and period) and collapsed text.

    The collapsed text has the words outside runs and each run's first period, joined by
    one space. ``alter`` may replace a document's words, given as its id and the words'
    numbers, before the search. There is no shuffle: each task works through chunks of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            number: dict[bytes, int] = {}
            texts = [
                np.array([number.setdefault(w, len(number)) for w in text.split()], np.int64)
                for text in utf8(part.column("text"))
            ]
            if alter:
                ids = part.column("doc_id").to_pylist()
                texts = [alter(i, words) for i, words in zip(ids, texts, strict=True)]
            found = runs_of(texts)
            spelled = np.array([*number, b""], object)
            kept = [
                b" ".join(spelled[words[~repeated(len(words), runs)] if runs else words].tolist())
                for words, runs in zip(texts, found, strict=True)
            ]
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, found)])
            each = pa.StructArray.from_arrays(
                [pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]
            )
            yield pa.record_batch({
                "doc_id": part.column("doc_id"),
                "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each),
                "collapsed": pa.array(kept, pa.binary()),
            })

    schema = (
        "doc_id long, runs array<struct<start: long, length: long, period: long>>, "
        "collapsed binary"
    )
    found = docs.select("doc_id", "text").mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the one of the most periods, and digests of runs and text.

    Equal exponents, compared as exact fractions, go by start and period.
    """
    a_first = F.expr("""array_sort(runs, (a, b) -> case
        when a.length * b.period > b.length * a.period then -1
        when a.length * b.period < b.length * a.period then 1
        when a.start < b.start or a.start = b.start and a.period < b.period then -1
        when a.start > b.start or a.period > b.period then 1 else 0 end)""")
    lines = F.expr(
        "array_join(transform(runs, r -> "
        "concat(r.start, ',', r.length, ',', r.period, char(10))), '')"
    )
    return found.withColumn("best", F.get(a_first, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The contract's words: one id in ten repeats a stretch to its end."""
    hashed = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    size = len(words)
    if hashed % 10 or not size:
        return words
    g = hashed // 10
    a = g % size
    p = 1 + (size - a) // (3 + g % 8)
    place = np.arange(size)
    return words[np.where(place >= a, a + (place - a) % p, place)]
