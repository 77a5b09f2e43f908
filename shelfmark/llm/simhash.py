"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has a bit where over half of its word shingles' hashes have it.
Two fingerprints are linked when at most ``radius`` bits differ, and a component is
what links connect.

Fingerprints that differ in at most two bits agree on two of four 16-bit parts, so
each distinct fingerprint goes to six buckets, one for each pair of parts. Inside a
bucket, fingerprints are compared bit-sliced: plane b is one long integer that holds
bit b of every fingerprint of a block, a plane shifted by s lines each fingerprint up
with the s-th after it, and carry-save counters add up the differing bits of all these
pairs at once. A block is left as soon as every pair in it is over the radius.

A bucket over ``largest_bucket`` fingerprints is not compared pairwise. Its members
are linked through the values within one bit of them: two fingerprints are within two
bits exactly if they share such a value. That costs 65 rows for a fingerprint, whatever
the bucket holds, and is exact as well.

Only links that join something new leave a task. Components are contracted in rounds,
each a few joins over the remaining links.

Defined cases: a null text is empty; an empty text or one without a word has
fingerprint 0 and is linked like any other; a text with fewer words than a shingle
has one shingle, all its words; repeated rows are separate rows with equal results; a
null id gets the component of its fingerprint, null if no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, utf8
from shelfmark.sources.shared import settle

SEED = 42
PARTS, PART_BITS = 4, 16
BLOCK_ROWS = 1 << 16
LARGEST_BUCKET = 1 << 14


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text, as a signed number."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    digest, join, last = xxhash.xxh64_intdigest, b" ".join, len(words) - shingle + 1
    over = np.zeros(64, np.int64)
    for start in range(0, last, BLOCK_ROWS):
        stop = min(last, start + BLOCK_ROWS)
        hashes = np.array(
            [digest(join(words[i : i + shingle]), SEED) for i in range(start, stop)], "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(over * 2 > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, *carried: str) -> DataFrame:
    """doc_id, ``carried`` and fingerprint, all long, for each row of ``docs`` (.., text)."""
    names = ("doc_id", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = [fingerprint(x, shingle) for x in utf8(part.column("text"))]
            columns = {x: part.column(x) for x in names}
            yield pa.record_batch({**columns, "fingerprint": pa.array(found, pa.int64())})

    schema = ", ".join(f"{x} long" for x in (*names, "fingerprint"))
    return docs.select(*names, "text").mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of 0..n-1's component under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(root, before):
            return root


def planes_of(values: np.ndarray) -> list[int]:
    """64 long integers: bit i of plane b is bit b of value i."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in rows]


def bit_positions(mask: int, n: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:n])


def close_pairs(
    values: np.ndarray, last: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j with j <= last[i] whose values differ in at most ``radius`` bits.

    ``last`` is the end of i's bucket. The counters start at what is missing to an
    overflow after ``radius`` bits, so one carry out of them marks a pair as too far.
    """
    n, planes = len(values), planes_of(values)
    full = (1 << n) - 1
    width = (radius + 1).bit_length() if (radius + 1) & radius else radius.bit_length()
    start = (1 << width) - 1 - radius
    room = last - np.arange(n)
    for shift in range(1, int(room.max(initial=0)) + 1):
        packed = np.packbits(room >= shift, bitorder="little")
        open_pairs = int.from_bytes(packed.tobytes(), "little")
        counters = [full if start >> k & 1 else 0 for k in range(width)]
        for plane in planes:
            carry = plane ^ (plane >> shift)
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            open_pairs &= ~carry
            if not open_pairs:
                break
        if open_pairs:
            i = bit_positions(open_pairs, n)
            yield i, i + shift


def links_of_buckets(bucket: np.ndarray, values: np.ndarray, radius: int) -> pa.RecordBatch:
    """Spanning links a > b among the close values of each bucket (rows in bucket order)."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    found_a, found_b = [], []
    for step in range(1, int(sizes.max(initial=0)).bit_length() + 1):
        # buckets of like sizes share blocks, so that short ones are done after few shifts
        chosen = np.flatnonzero((sizes >= 1 << (step - 1)) & (sizes < 1 << step) & (sizes > 1))
        block, rows = [], 0
        for k in [*chosen, -1]:
            if rows and (k < 0 or rows + sizes[k] > BLOCK_ROWS):
                where = np.concatenate([np.arange(starts[x], starts[x] + sizes[x]) for x in block])
                own = np.array([sizes[x] for x in block])
                last = np.repeat(np.cumsum(own) - 1, own)
                root = np.arange(len(where))
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for pair in close_pairs(values[where], last, radius):
                    held.append(pair)
                    if sum(len(x) for x, _ in held) > 4 * BLOCK_ROWS:
                        held = [(root, np.arange(len(root))), *held]
                        root = forest(*map(np.concatenate, zip(*held, strict=True)), len(root))
                        held = []
                held = [(root, np.arange(len(root))), *held]
                root = forest(*map(np.concatenate, zip(*held, strict=True)), len(root))
                moved = np.flatnonzero(root != np.arange(len(root)))
                found_a.append(values[where[moved]])
                found_b.append(values[where[root[moved]]])
                block, rows = [], 0
            if k >= 0:
                block.append(k)
                rows += sizes[k]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets of rows (bucket, value), compared bit-sliced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if left is None else pa.concat_tables([left, part])
            bucket = part.column("bucket").to_numpy()
            # the last bucket may go on in the next batch
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            left = part.slice(cut)
            if cut:
                yield links_of_buckets(bucket[:cut], part.column("value").to_numpy()[:cut], radius)
        if left is not None and left.num_rows:
            bucket, value = (left.column(x).to_numpy() for x in ("bucket", "value"))
            yield links_of_buckets(bucket, value, radius)

    return (
        rows.repartition("bucket")
        .sortWithinPartitions("bucket", "value")
        .mapInArrow(run, "a long, b long")
    )


def neighbour_links(values: DataFrame, radius: int) -> DataFrame:
    """Links among values through all values within ``radius / 2`` bits of them."""
    flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    if radius > 2:
        raise ValueError("neighbours are listed for a radius of up to 2")
    near = F.explode(F.transform(F.lit(flips), lambda f: F.col("value").bitwiseXOR(f)))
    groups = values.select("value", near.alias("near")).groupBy("near")
    # a group has 65 values at most: those within one bit of its key
    groups = groups.agg(F.collect_set("value").alias("values")).filter(F.size("values") > 1)
    low = F.array_min("values")
    return groups.select(F.explode("values").alias("a"), low.alias("b")).filter("a <> b")


def links(values: DataFrame, radius: int = 2, largest_bucket: int = LARGEST_BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct ``value``s within ``radius`` <= 2 bits."""
    mask = (1 << PART_BITS) - 1
    part = [
        F.shiftrightunsigned("value", PART_BITS * k).bitwiseAND(F.lit(mask)) for k in range(PARTS)
    ]
    # parts minus radius of them agree: with four parts and two bits, two parts
    keys = [
        F.lit(n).cast("long") * (1 << 2 * PART_BITS) + part[i] * (1 << PART_BITS) + part[j]
        for n, (i, j) in enumerate(combinations(range(PARTS), PARTS - 2))
    ]
    rows = values.select("value", F.explode(F.array(*keys)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = settle(rows.join(sizes, "bucket"), "simhash_buckets")
    small = shared.filter(F.col("size") <= largest_bucket).select("bucket", "value")
    large = shared.filter(F.col("size") > largest_bucket).select("value").distinct()
    return bucket_links(small, radius).unionByName(neighbour_links(large, radius)).distinct()


#: Rounds in which links must be gone; each leaves at most a constant part of them.
MOST_ROUNDS = 200


def roots(edges: DataFrame) -> DataFrame:
    """value, root: the same root for all values that ``edges`` (a, b) connect.

    Each round sends every value to the neighbour of least hash and goes on with the
    links between those, fewer by a constant factor; links and roots are written after
    each round, so lineage stays short.
    """
    edges = settle(edges, "links")
    found, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        if turn > MOST_ROUNDS:
            raise RuntimeError(f"links are left after {MOST_ROUNDS} rounds")
        both = edges.select("a", "b").union(edges.select("b", "a"))
        order = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("v"))
        best = both.groupBy("a").agg(F.min(order).alias("low")).select(
            F.col("a").alias("value"),
            F.when(
                F.col("low.h") < F.xxhash64("a", F.lit(turn)), F.col("low.v")
            ).otherwise(F.col("a")).alias("root"),
        )
        best = settle(best, "nearest")
        left = best.select(F.col("value").alias("a"), F.col("root").alias("ra"))
        right = best.select(F.col("value").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").filter("ra <> rb")
        edges = settle(
            edges.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct(), "links",
        )
        if found is None:
            found = best
        else:
            up = best.select(F.col("value").alias("root"), F.col("root").alias("above"))
            found = found.join(up, "root", "left").select(
                "value", F.coalesce("above", "root").alias("root")
            )
            found = settle(found, "roots")
    if found is None:
        return edges.select(F.col("a").alias("value"), F.col("b").alias("root"))
    return found


def named_values(
    prints: DataFrame, radius: int = 2, largest_bucket: int = LARGEST_BUCKET
) -> DataFrame:
    """fingerprint, component_id, and the fingerprint of the component's first row: of its
    rows of the smallest id, the least."""
    values = prints.groupBy(F.col("fingerprint").alias("value")).agg(
        F.min("doc_id").alias("first")
    )
    values = settle(values, "fingerprint_values")
    root = roots(links(values.select("value"), radius, largest_bucket))
    members = values.join(root, "value", "left").select(
        "value", "first", F.coalesce("root", "value").alias("root")
    )
    least = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "value")))
    lowest = members.groupBy("root").agg(least.alias("least"))
    return members.join(lowest, "root").select(
        F.col("value").alias("fingerprint"), F.col("least.first").alias("component_id"),
        F.col("least.value").alias("first_fingerprint"),
    )


def components(
    docs: DataFrame, shingle: int = 3, radius: int = 2, largest_bucket: int = LARGEST_BUCKET
) -> DataFrame:
    """doc_id, fingerprint (long), component_id for each row of ``docs`` (doc_id, text)."""
    prints = settle(fingerprints(docs, shingle), "fingerprints")
    named = named_values(prints, radius, largest_bucket)
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each component: the first by id, fingerprint and row hash.

    Rows without an id stay: nothing tells them apart.
    """
    marked = docs.withColumn("row_mark", F.xxhash64("text", *docs.columns))
    prints = settle(fingerprints(marked, shingle, "row_mark"), "fingerprints")
    found = prints.join(named_values(prints, radius), "fingerprint")
    first = found.filter("doc_id = component_id and fingerprint = first_fingerprint")
    first = first.groupBy("doc_id", "fingerprint").agg(F.min("row_mark").alias("row_mark"))
    first = settle(first.select("doc_id", "row_mark"), "first_of_components")
    kept = marked.join(first, ["doc_id", "row_mark"], "left_semi")
    kept = kept.dropDuplicates(["doc_id", "row_mark"]).select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def hex_digits(fingerprint) -> F.Column:
    """16 lowercase hex digits of a long column."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
