"""Clustering vectors around centroids with zone maps in the order of a Hilbert curve.

Vectors are integers: floor(1024 * x) of each component. They are ordered along a Hilbert
curve over their first ``AXES`` principal coordinates and cut into blocks of ``BLOCK``
vectors, each with the least and greatest value of every principal coordinate (its box)
and its vectors' sum. The blocks are written once; every round reads them. Bounds of the
distance from a box to the centroids leave a block's candidates: a centroid goes if its
least distance exceeds the smallest greatest distance, or if another is nearer in the whole
box (the difference of two squared distances is linear, so its largest value over a box is
in a corner). Principal coordinates turn the box to where the centroids lie apart; bounds
have a slack far above their rounding. A block with one candidate gives its sum without a
look at its vectors; others are compared with their candidates in whole numbers. Tasks add
up sums and counts by cluster, Spark adds those, and the driver gets one number for each
cluster and component.

The order only decides how much is pruned, never the result. Copies of one vector are
dealt by id and row number, so they spread over tasks.

Defined cases: vectors of another width, null ones, and those with a null or non-finite
component are left out; without vectors there are no rows; fewer vectors than centroids
make as many centroids; vectors with one id, or none, are vectors of their own, those
without an id seed last; equal distances go to the smaller centroid; an empty centroid
stays. Blocks with a component of 2^22 or more have whole numbers of any size and no box,
and are compared with all centroids; distances and sums beyond a long are given as the
largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.shared import settle

AXES, BITS = 4, 16
BLOCK = 256
#: Part of the largest squared coordinate by which bounds may be off.
SLACK = 1e-9
#: Components below this are exact in float64 products and their sums.
SMALL = 1 << 22
LARGEST = (1 << 63) - 1
LIMB = 60
BLOCKS = "wide boolean, ids binary, known binary, vectors binary, low binary, high binary, total binary"


@dataclass(frozen=True)
class Frame:
    """Where boxes are measured: a whole-number origin and orthonormal principal axes."""

    origin: np.ndarray
    axes: np.ndarray
    deviation: np.ndarray

    def coordinates(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers - self.origin) @ self.axes


@dataclass(frozen=True)
class Clusters:
    """Final centroids, members and summed distances, and the block table they come from."""

    blocks: DataFrame
    frame: Frame
    centroids: list[list[int]]
    members: list[int]
    inertia: list[int]


def usable(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id and embedding, as doubles, of vectors with ``width`` finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    typed = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return typed.filter((F.size("embedding") == width) & F.coalesce(finite, F.lit(False)))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond a double."""
    scaled = x * scale
    return int(scaled // 1) if abs(scaled) < 2.0**1000 else int(x) * scale


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 where all are small, else as Python integers."""
    scaled = np.floor(np.clip(rows, -2 * SMALL, 2 * SMALL) * scale)
    if np.abs(scaled).max(initial=0) < SMALL:
        return scaled.astype(np.int64)
    found = np.empty(rows.shape, object)
    found[:] = [[whole(x, scale) for x in row] for row in rows.tolist()]
    return found


def encode(numbers: np.ndarray) -> bytes:
    if numbers.dtype == object:
        return ",".join(map(str, numbers.ravel().tolist())).encode()
    return numbers.astype("<i4").tobytes()


def decode(payload: bytes, wide: bool, width: int) -> np.ndarray:
    """Rows of ``width`` numbers: float64 with exact values, or Python integers."""
    if not wide:
        return np.frombuffer(payload, "<i4").reshape(-1, width).astype(np.float64)
    parts = [int(x) for x in payload.split(b",")]
    found = np.empty((len(parts) // width, width), object)
    found[:] = np.array(parts, object).reshape(-1, width)
    return found


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def curve_place(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (one row each, ``bits`` bits an axis).

    The transposed form: undo the rotations from the highest bit down, Gray-code the
    axes, and interleave their bits.
    """
    x = [axis.astype(np.int64) for axis in cells.T]
    for bit in range(bits - 1, 0, -1):
        half, below = 1 << bit, (1 << bit) - 1
        for i in range(len(x)):
            upper = (x[i] & half) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << bit), turn ^ ((1 << bit) - 1), turn)
    place = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << np.uint64(1) | ((axis ^ turn) >> bit & 1).astype(np.uint64)
    return place


def calm(rows: np.ndarray) -> np.ndarray:
    """Components cut to a million, for the order alone."""
    return np.clip(rows, -1e6, 1e6)


def principal_frame(vectors: DataFrame, width: int, scale: int) -> Frame:
    """Origin, principal axes and deviations, from sums over all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, width + 1))
        for batch in batches:
            rows = calm(matrix(batch.column("embedding"), width))
            rows = np.hstack([rows, np.ones((len(rows), 1))])
            sums += rows.T @ rows
        yield pa.record_batch({"place": np.arange(sums.size), "part": sums.ravel()})

    parts = vectors.select("embedding").mapInArrow(moments, "place long, part double")
    found = parts.groupBy("place").agg(F.sum("part").alias("part")).collect()
    sums = np.zeros((width + 1) ** 2)
    for row in found:
        sums[row.place] = row.part
    sums = sums.reshape(width + 1, width + 1)
    mean = sums[-1, :-1] / max(sums[-1, -1], 1)
    spread = sums[:-1, :-1] / max(sums[-1, -1], 1) - np.outer(mean, mean)
    size, axes = np.linalg.eigh(spread)
    deviation = scale * np.sqrt(np.maximum(size[::-1], 0))
    return Frame(np.floor(mean * scale), axes[:, ::-1], deviation)


def build_blocks(vectors: DataFrame, frame: Frame, width: int, scale: int) -> DataFrame:
    """The block table: vectors of ``usable`` in the curve's order, with boxes and sums."""
    deviation = frame.deviation[:AXES]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = 1 << BITS
        for batch in batches:
            rows = scale * calm(matrix(batch.column("embedding"), width))
            rows = frame.coordinates(rows)[:, :AXES]
            inside = np.divide(rows, 6 * deviation, where=deviation > 0, out=np.zeros_like(rows))
            at = curve_place(np.clip((inside + 0.5) * cells, 0, cells - 1).astype(np.int64))
            signed = (at ^ np.uint64(1 << 63)).view(np.int64)
            yield batch.append_column("place", pa.array(signed))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = integers(matrix(batch.column("embedding"), width), scale)
            ids = batch.column("vec_id")
            known, ids = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy(False)
            out = []
            for i in range(0, len(numbers), BLOCK):
                part, stop = numbers[i : i + BLOCK], i + BLOCK
                if part.dtype == object and all(abs(x) < SMALL for x in part.flat):
                    part = part.astype(np.int64)
                wide = part.dtype == object
                box = np.zeros((0, width)) if wide else frame.coordinates(part)
                out.append({
                    "wide": wide, "ids": ids[i:stop].astype("<i8").tobytes(),
                    "known": known[i:stop].tobytes(), "vectors": encode(part),
                    "low": b"" if wide else box.min(axis=0).astype("<f8").tobytes(),
                    "high": b"" if wide else box.max(axis=0).astype("<f8").tobytes(),
                    "total": encode(part.sum(axis=0)),
                })
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=BLOCK_SCHEMA)

    kind = "vec_id long, embedding array<double>, row long"
    spread = F.xxhash64("vec_id")
    ordered = (
        vectors.withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(place, f"{kind}, place long")
        .repartitionByRange("place", spread, "row")
        .sortWithinPartitions("place", spread, "row")
    )
    return settle(ordered.mapInArrow(cut, BLOCKS), "zone_map")


BLOCK_SCHEMA = pa.schema(
    [("wide", pa.bool_()), *((n, pa.binary()) for n in ("ids", "known", "vectors", "low", "high", "total"))]
)


def as_numbers(centroids: list[list[int]]) -> np.ndarray:
    """Centroids as float64 where their values are small, else as Python integers."""
    if all(abs(x) < SMALL for c in centroids for x in c):
        return np.array(centroids, np.float64)
    found = np.empty((len(centroids), len(centroids[0])), object)
    found[:] = centroids
    return found


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector in the box, in ascending order.

    All are coordinates in one frame.
    """
    size = max(np.abs(low).max(), np.abs(high).max(), np.abs(centroids).max())
    slack = SLACK * size * size
    below, above = low - centroids, centroids - high
    outside = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(-below, -above)
    least, most = (outside * outside).sum(axis=1), (farthest * farthest).sum(axis=1)
    best = int(most.argmin())
    # d(x, best) - d(x, c) = |best|^2 - |c|^2 + 2 x (c - best), at its largest in a corner
    slope = centroids - centroids[best]
    corner = np.maximum(slope * low, slope * high).sum(axis=1)
    squares = (centroids * centroids).sum(axis=1)
    lead = squares[best] - squares + 2 * corner
    return np.flatnonzero((least <= most[best] + slack) & (lead >= -slack))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid of each vector."""
    squares = (centroids * centroids).sum(axis=1)
    apart = (vectors * vectors).sum(axis=1)[:, None] + squares - 2 * (vectors @ centroids.T)
    found = apart.argmin(axis=1)
    return found, apart[np.arange(len(found)), found]


class Blocks:
    """The rows of a batch of the block table, beside ``centroids``."""

    def __init__(self, batch: pa.RecordBatch, centroids: np.ndarray, frame: Frame):
        self.columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        self.centroids, self.width = centroids, centroids.shape[1]
        self.turned = None if centroids.dtype == object else frame.coordinates(centroids)

    def __iter__(self):
        return iter(range(len(self.columns["wide"])))

    def candidates(self, i: int) -> np.ndarray:
        if self.columns["wide"][i] or self.turned is None:
            return np.arange(len(self.centroids))
        low, high = (np.frombuffer(self.columns[name][i], "<f8") for name in ("low", "high"))
        return candidates(low, high, self.turned)

    def nearest(self, i: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's vectors, their clusters and distances."""
        vectors = decode(self.columns["vectors"][i], self.columns["wide"][i], self.width)
        centroids = self.centroids[among]
        if vectors.dtype != centroids.dtype:
            vectors, centroids = any_size(vectors), any_size(centroids)
        found, apart = nearest(vectors, centroids)
        return vectors, among[found], apart


def any_size(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers."""
    return numbers if numbers.dtype == object else numbers.astype(np.int64).astype(object)


def totals(
    blocks: DataFrame, frame: Frame, centroids: list[list[int]], distances: bool
) -> list[list[int]]:
    """Sums of components, number of vectors and, if asked for, of distances by cluster."""
    width, numbers = len(centroids[0]), as_numbers(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), width + 2), object)
        for batch in batches:
            rows = Blocks(batch, numbers, frame)
            for i in rows:
                among = rows.candidates(i)
                if len(among) == 1 and not distances:
                    total = decode(rows.columns["total"][i], rows.columns["wide"][i], width)[0]
                    size = len(rows.columns["known"][i])
                    sums[among[0]] += np.array([*map(int, total), size, 0], object)
                    continue
                vectors, cluster, apart = rows.nearest(i, among)
                for c in np.unique(cluster):
                    own = cluster == c
                    far = sum(map(int, apart[own])) if distances else 0
                    parts = [*vectors[own].sum(axis=0), own.sum(), far]
                    sums[c] += np.array([int(x) for x in parts], object)
        out = [
            (c, place, limb, part)
            for c in range(len(centroids))
            for place, value in enumerate(sums[c].tolist())
            for limb, part in enumerate(limbs(value))
        ]
        names = ("cluster", "place", "limb", "part")
        columns = zip(*out, strict=True) if out else ((),) * 4
        yield pa.record_batch({n: pa.array(x, pa.int64()) for n, x in zip(names, columns, strict=True)})

    needed = blocks if distances else blocks.withColumn("ids", F.lit(b""))
    parts = needed.mapInArrow(add, "cluster long, place long, limb long, part long")
    part = F.sum(F.col("part").cast("decimal(38,0)")).alias("part")
    found = [[0] * (width + 2) for _ in centroids]
    for row in parts.groupBy("cluster", "place", "limb").agg(part).collect():
        found[row.cluster][row.place] += int(row.part) << LIMB * row.limb
    return found


def limbs(value: int) -> list[int]:
    """Digits of ``LIMB`` bits, lowest first, the last with the sign; none for zero."""
    found = []
    while value and not -(1 << LIMB) < value < 1 << LIMB:
        found.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*found, value] if value else found


def seeds(vectors: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of salt and id, as integers."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(by.asc_nulls_last(), "embedding").limit(k).select("embedding")
    return [[whole(x, scale) for x in row.embedding] for row in first.collect()]


def cluster(
    vectors: DataFrame, k: int, rounds: int, width: int, scale: int = 1024, salt: str = ""
) -> Clusters | None:
    """Clusters of the usable vectors after ``rounds`` rounds; None without vectors."""
    kept = usable(vectors, width)
    centroids = seeds(kept, k, scale, salt)
    if not centroids:
        return None
    frame = principal_frame(kept, width, scale)
    blocks = build_blocks(kept, frame, width, scale)
    for _ in range(rounds):
        sums = totals(blocks, frame, centroids, distances=False)
        centroids = [
            [x // s[width] for x in s[:width]] if s[width] else c
            for s, c in zip(sums, centroids, strict=True)
        ]
    sums = totals(blocks, frame, centroids, distances=True)
    return Clusters(blocks, frame, centroids, [s[width] for s in sums], [s[width + 1] for s in sums])


def assign(clusters: Clusters) -> DataFrame:
    """vec_id, cluster, distance of every vector of the block table."""
    numbers, frame = as_numbers(clusters.centroids), clusters.frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Blocks(batch, numbers, frame)
            for i in rows:
                _, found, apart = rows.nearest(i, rows.candidates(i))
                ids = np.frombuffer(rows.columns["ids"][i], "<i8")
                known = np.frombuffer(rows.columns["known"][i], bool)
                yield pa.record_batch({
                    "vec_id": pa.array(ids, mask=~known),
                    "cluster": pa.array(found.astype(np.int32)),
                    "distance": pa.array([min(int(x), LARGEST) for x in apart], pa.int64()),
                })

    needed = clusters.blocks.select("wide", "ids", "known", "vectors", "low", "high")
    return needed.mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(clusters: Clusters | None, vectors: DataFrame) -> DataFrame:
    """``assign`` with each cluster's and all summed distances, and the centroid's hash."""
    if clusters is None:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid_sha256 string",
        )
    hashes = [
        hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in clusters.centroids
    ]
    own = F.array(*(F.lit(min(x, LARGEST)).cast("long") for x in clusters.inertia))
    return assign(clusters).withColumns({
        "cluster_inertia": F.get(own, F.col("cluster")),
        "inertia": F.lit(min(sum(clusters.inertia), LARGEST)).cast("long"),
        "centroid_sha256": F.get(F.array(*map(F.lit, hashes)), F.col("cluster")),
    })


def oracle(k: int = 8, rounds: int = 10, width: int = 64, salt: str = "3:") -> str:
    """The same as DuckDB SQL: every round compares all vectors with all centroids."""
    floor_mean = "(s - ((s % n) + n) % n) // n"
    steps = [f"""
v as materialized (
  select row_number() over () as r, vec_id,
         list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where len(embedding) = {width}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width}),
x as materialized (select r, unnest(e) as x, unnest(range({width})) as d from v),
c0 as materialized (
  select row_number() over (order by sha256('{salt}' || vec_id) nulls last, e) - 1 as c, e from v
  qualify c < {k}),
m0 as materialized (select c, unnest(e) as x, unnest(range({width})) as d from c0)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select r, arg_min(c, (apart, c)) as c, min(apart) as apart from (
    select r, c, cast(sum((x.x - m.x) * (x.x - m.x)) as bigint) as apart
    from x join m{i} m using (d) group by r, c) group by r)""")
        if i < rounds:
            steps.append(f"""
m{i + 1} as materialized (
  select m.c, m.d, coalesce(t.x, m.x) as x from m{i} m left join (
    select c, d, cast({floor_mean} as bigint) as x from (
      select c, d, cast(sum(x) as bigint) as s, count(*) as n
      from x join a{i} using (r) group by c, d)) t using (c, d))""")
    return f"""
with {",".join(steps)},
h as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256
      from m{rounds} group by c)
select vec_id, cast(a.c as integer) as cluster, apart as distance,
       cast(sum(apart) over (partition by a.c) as bigint) as cluster_inertia,
       cast(sum(apart) over () as bigint) as inertia, centroid_sha256
from a{rounds} a join v using (r) join h on h.c = a.c"""
