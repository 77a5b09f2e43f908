"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each n, the sum of its first n characters times
powers of a base, modulo a prime. The hash of any span is a difference in it, shifted to
the beginning, so equal spans are compared in one step wherever they lie. Two primes
below 2^31 make up 62 bits.

A fingerprint holds the whole text's hash, the hashes of prefixes and suffixes of
lengths that grow by ``GROWTH``, and the ``SKETCH`` least hashes of spans of ``SPAN``
characters, of 48 bits each, so that unrelated texts of any length share none. Of two fingerprints, binary search among the prefixes and the suffixes finds
the longest common extension from either end; their share of the longer text, or the
resemblance of the sketches if that is more, is the likeness. Equal texts have 1, others
less than 1.

The next document is the one before it by id, the largest id after the last; documents
without an id come last, ties in the order of their texts. Texts are dealt by ranges of
ids once, so that a task has its documents' neighbours; the first text of each range is
also sent to the range before it, where it ends the sequence. Nothing else is written.

Defined cases: a null text is empty; an empty text's likeness to an empty one is 1, to
others 0; the next of the only document is itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import CHUNK_BYTES, chunks, mix
from shelfmark.sources.shared import settle

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
GROWTH = 1.15
SPAN = 16
LONGEST = 1 << 31  # characters; Spark's strings have fewer
SKETCH = 48
DIGITS = 6
SKETCH_DIGITS = 12
#: Tasks stream their ranges, so a range may be larger than memory.
RANGE_BYTES = 128_000_000


def growing(most: int) -> np.ndarray:
    out, x = [], 1.0
    while x <= most:
        out.append(int(x))
        x = max(x * GROWTH, int(x) + 1)
    return np.array(out, np.int64)


ALL_STEPS = growing(LONGEST)


class Powers:
    """Powers of the bases and of their inverses, as far as they were asked for."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def grow(self, n: int) -> None:
        for i, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            for table, factor in ((self.up, base), (self.down, pow(base, -1, prime))):
                while len(table[i]) < n:
                    step = np.uint64(pow(factor, len(table[i]), prime))
                    table[i] = np.r_[table[i], table[i] * step % np.uint64(prime)]


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        powers.grow(len(codes) + 1)
        self.powers, self.sums = powers, []
        value = codes.astype(np.uint64) + np.uint64(1)
        for i, prime in enumerate(PRIMES):
            prime = np.uint64(prime)
            terms = value * powers.up[i][: len(value)] % prime
            self.sums.append(np.r_[np.uint64(0), np.cumsum(terms) % prime])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of each span, the same for equal spans anywhere."""
        parts = []
        for i, prime in enumerate(PRIMES):
            prime, sums = np.uint64(prime), self.sums[i]
            parts.append((sums[stop] + prime - sums[start]) % prime * self.powers.down[i][start] % prime)
        return mix(parts[0] << np.uint64(31) | parts[1])

    def short_spans(self, size: int, start: np.ndarray | None = None, by: int = 0) -> np.ndarray:
        """A hash of the span of ``size`` characters from each ``start``, or from each
        position, by one prime."""
        prime, sums, down = np.uint64(PRIMES[by]), self.sums[by], self.powers.down[by]
        if start is None:
            found = (sums[size:] + prime - sums[:-size]) % prime
            return mix(found * down[: len(found)] % prime)
        return mix((sums[start + size] + prime - sums[start]) % prime * down[start] % prime)

    def sketch(self, size: int, count: int) -> np.ndarray:
        """The ``count`` least different hashes of spans of ``size`` characters.

        32 bits by the first prime, then 16 by the second, which only the least need.
        """
        first = self.short_spans(size) >> np.uint64(32)
        start = np.flatnonzero(first <= least(first, count)[-1])
        second = self.short_spans(size, start, 1) >> np.uint64(48)
        return least(first[start] << np.uint64(16) | second, count)


def least(values: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` least different values, in order."""
    if len(values) > 8 * count:
        few = np.unique(np.partition(values, 4 * count)[: 4 * count])
        if len(few) >= count:
            return few[:count]
    return np.unique(values)[:count]


def steps(n: int) -> np.ndarray:
    """Lengths up to ``n`` that grow by ``GROWTH``, the same for all texts."""
    return ALL_STEPS[: int(np.searchsorted(ALL_STEPS, n, side="right"))]


def fingerprint(text: str, powers: Powers) -> str:
    """Length, whole hash, prefixes, suffixes and sketch, in hex, between dots."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(codes)
    arrays, at = Prefixes(codes, powers), steps(n)
    zero = np.zeros(1, np.int64)
    whole = int(arrays.spans(zero, zero + n)[0])
    short = np.uint64(64 - 4 * DIGITS)
    ahead = arrays.spans(np.zeros_like(at), at) >> short
    behind = arrays.spans(n - at, np.full_like(at, n)) >> short
    sketch = arrays.sketch(SPAN, SKETCH) if n >= SPAN else np.zeros(0, np.uint64)
    written = lambda xs, digits: "".join(f"{x:0{digits}x}" for x in xs.tolist())
    ends = f"{written(ahead, DIGITS)}.{written(behind, DIGITS)}"
    return f"{n:x}.{whole:016x}.{ends}.{written(sketch, SKETCH_DIGITS)}"


def common(a: str, b: str) -> int:
    """How many hashes two equal-step lists share from the start, by binary search."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        middle = (low + high + 1) // 2
        at = slice((middle - 1) * DIGITS, middle * DIGITS)
        if a[at] == b[at]:
            low = middle
        else:
            high = middle - 1
    return low


def likeness(one: str, two: str) -> float:
    """0 to 1 by the fingerprints alone."""
    if one == two:
        return 1.0
    a, b = one.split("."), two.split(".")
    n, m = int(a[0], 16), int(b[0], 16)
    if not min(n, m):
        return 0.0
    at = steps(min(n, m))
    reach = 0
    for side in (2, 3):
        found = common(a[side], b[side])
        reach += int(at[found - 1]) if found else 0
    shared = min(reach, min(n, m)) / max(n, m)
    cut = lambda x: {x[i : i + SKETCH_DIGITS] for i in range(0, len(x), SKETCH_DIGITS)}
    left, right = cut(a[4]), cut(b[4])
    lowest = sorted(left | right)[:SKETCH]
    alike = sum(x in left and x in right for x in lowest) / max(1, len(lowest))
    return min(max(shared, alike), 1 - 1 / (max(n, m) + 1))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def compared(doc_id, text: str, print_: str, following: str, next_print: str, powers: Powers):
    """A row of the result for a text and the one that follows."""
    n = len(text)
    k = n // 3
    edited = text[: n - k] + following[:k]
    edited_print = fingerprint(edited, powers)
    return (
        doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), print_, edited_print,
        likeness(print_, edited_print), likeness(print_, next_print),
    )


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    columns = [pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def by_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` with ``part``, the number of the row's range of ids; no id is the lowest."""
    inner = [i / ranges for i in range(1, ranges)]
    bounds = docs.approxQuantile("doc_id", inner, 0.1 / ranges) if inner else []
    bucket = Bucketizer(
        splits=[-np.inf, *(sorted(set(bounds)) or [0.0]), np.inf], inputCol="place", outputCol="part"
    )
    placed = F.coalesce(F.col("doc_id").cast("double"), F.lit(-np.inf))
    return bucket.transform(docs.withColumn("place", placed)).drop("place")


def followers(docs: DataFrame) -> DataFrame:
    """For each range (``part``) the text after its last one: the next range's first."""
    openings = settle(docs.groupBy("part").agg(F.max("doc_id").alias("first_id")), "openings")
    order = Window.orderBy("part")  # one row for each range
    before = F.coalesce(
        F.lead("part").over(order), F.min("part").over(order.rowsBetween(*ALL_ROWS))
    )
    openings = openings.select(F.col("part").alias("own"), "first_id", before.alias("before"))
    same = (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return docs.join(openings, same).groupBy("before").agg(F.min("text").alias("text"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, before = Powers(), None
        for batch in chunks(batches, "text", CHUNK_BYTES):
            rows = []
            names = ("doc_id", "text", "follows")
            for doc_id, text, follows in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                now = (doc_id, text, fingerprint(text, powers))
                if before is not None:
                    rows.append(compared(*before, *now[1:], powers))
                before = None if follows else now
            if rows:
                yield batch_of(rows, SCHEMA)

    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    ranged = by_ranges(docs, ranges)
    ends = followers(ranged).select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("part"),
        F.lit(True).alias("follows"),
    )
    rows = ranged.withColumn("follows", F.lit(False)).unionByName(ends)
    # each range is a task of its own, which hashing the ranges' numbers would not give
    rows = rows.repartitionById(ranges, F.col("part").cast("int"))
    order = ("part", "follows", F.desc_nulls_last("doc_id"), "text")
    return rows.sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


ALL_ROWS = (Window.unboundedPreceding, Window.unboundedFollowing)
