"""CSV records whose quoted values hold line breaks, read by many tasks a file.

A task reads a byte range of a file as lines and cannot see whether it starts inside a
quoted value. So the quoted lines are looked at first: each range tells where its last line
ends, inside a value or not, if it starts outside and if it starts inside one. Chaining
these along a file gives the true start of each range. A second pass joins the lines of
a record; of records that cross ranges it gives the pieces, which then meet by file and
record. Files without a line break in a value take no second pass: Spark's own reader
splits those by lines.

Ranges are Spark's scan splits. Their size depends on the number of cores, so it is fixed
for both passes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.sources.shared import settle

QUOTE, COMMA = '"', ","
MIN_SPLITS = "spark.sql.files.minPartitionNum"
STATES = "path string, start long, if_outside boolean, if_inside boolean, breaks boolean"
PIECES = "record string, path string, start long, place int, opens boolean"


@contextmanager
def fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Scans planned within cut files alike, even if executors come or go."""
    before = spark.conf.get(MIN_SPLITS, None)
    spark.conf.set(MIN_SPLITS, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(MIN_SPLITS)
        else:
            spark.conf.set(MIN_SPLITS, before)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files with the file and first byte of their scan split, in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted value, if it starts so.

    A quote opens a value only at a field's start; doubled, it is part of the value;
    elsewhere it is text.
    """
    parts = line.split(QUOTE)
    closed = False
    for i, part in enumerate(parts[:-1]):
        if inside:
            inside, closed = False, True
        else:
            inside = part.endswith(COMMA) or not part and (closed or i == 0)
            closed = False
    return inside


def split_states(lines: DataFrame) -> DataFrame:
    """How each split with quotes ends, from either start, and whether a value breaks there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, breaks = None, (False, True), False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "start", "value"))
            for path, start, value in zip(*columns, strict=True):
                if (path, start) != key:
                    if key:
                        yield state_row(key, ends, breaks)
                    key, ends, breaks = (path, start), (False, True), False
                outside = ends_inside(value, ends[0])
                same = ends[0] == ends[1]
                ends = (outside, outside if same else ends_inside(value, ends[1]))
                breaks |= outside
        if key:
            yield state_row(key, ends, breaks)

    return lines.filter(F.col("value").contains(QUOTE)).mapInArrow(run, STATES)


def state_row(key: tuple[str, int], ends: tuple[bool, bool], breaks: bool) -> pa.RecordBatch:
    names = ["path", "start", "if_outside", "if_inside", "breaks"]
    return pa.RecordBatch.from_pylist([dict(zip(names, (*key, *ends, breaks), strict=True))])


def changes(states: DataFrame) -> dict[str, tuple[list[int], list[bool]]]:
    """By file, the splits after whose end the state differs from before, and the new state.

    A split either sets the state, whatever it was, or flips it, or keeps it. So the
    state after a split is the last one set, flipped as often as splits since then flip.
    At most one row for each scan split comes to the driver, which planned them all;
    as a rule it is one for each split that ends inside a value.
    """
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("if_outside") == F.col("if_inside")
    flips = F.sum(F.when(~sets & F.col("if_outside"), 1).otherwise(0)).over(earlier) % 2
    relative = F.when(sets, F.col("if_outside").cast("int") + F.col("flips"))
    last = F.coalesce(F.last("relative", ignorenulls=True).over(earlier), F.lit(0))
    before = F.lag("ends", 1, False).over(Window.partitionBy("path").orderBy("start"))
    rows = (
        states.withColumn("flips", flips)
        .withColumn("relative", relative)
        .withColumn("ends", (last + F.col("flips")) % 2 == 1)
        .withColumn("before", before)
        .filter("ends != before")
        .orderBy("path", "start")
    )
    found: dict[str, tuple[list[int], list[bool]]] = {}
    for row in rows.collect():
        starts, ends = found.setdefault(row.path, ([], []))
        starts.append(row.start)
        ends.append(row.ends)
    return found


def stitched(lines: DataFrame, states: DataFrame) -> DataFrame:
    """All records but the files' first, which are headers, as ``record``.

    Pieces of records that cross splits have their file, split and place; others none.
    """
    changed = changes(states)

    def starts_inside(path: str, start: int) -> bool:
        starts, ends = changed.get(path, ([], []))
        at = bisect_left(starts, start)
        return at > 0 and ends[at - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: Split | None = None
        for batch in batches:
            keys = list(
                zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True)
            )
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for first, stop in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if split is None or split.key != keys[first]:
                    if split is not None:
                        yield split.rest()
                    split = Split(keys[first], starts_inside(*keys[first]))
                yield split.take(batch.column("value").slice(first, stop - first))
        if split is not None:
            yield split.rest()

    return lines.mapInArrow(run, PIECES)


class Split:
    """The lines of one split on their way to records."""

    def __init__(self, key: tuple[str, int], inside: bool):
        self.key = key
        self.inside = self.leading = inside
        self.open: list[str] = []
        self.header = key[1] == 0

    def take(self, values: pa.Array) -> pa.RecordBatch:
        quoted = pc.match_substring(values, QUOTE).to_numpy(zero_copy_only=False).nonzero()[0]
        found: list[pa.Array] = []
        rows: list[tuple[str, str | None, int | None, int | None, bool | None]] = []
        at = 0
        for i in [*quoted.tolist(), len(values)]:
            if at < i:  # lines without a quote
                if self.inside:
                    self.open += values.slice(at, i - at).to_pylist()
                else:
                    found.append(self.whole(values.slice(at, i - at)))
            if i < len(values):
                line = values[i].as_py()
                self.open.append(line)
                self.inside = ends_inside(line, self.inside)
                if not self.inside:
                    rows += self.close()
            at = i + 1
        whole = pa.concat_arrays([pa.array([r[0] for r in rows], pa.string()), *found])
        blank = [None] * (len(whole) - len(rows))
        rest = [pa.array([*(r[k] for r in rows), *blank], kind) for k, kind in PLACES]
        return pa.record_batch([whole, *rest], COLUMNS)

    def whole(self, values: pa.Array) -> pa.Array:
        """Lines that are records; a file's first is its header, blank ones are none."""
        if pc.any(pc.ends_with(values, "\r")).as_py():
            values = pc.replace_substring_regex(values, "\r$", "")
        values = values.filter(pc.not_equal(values, ""))
        if self.header and len(values):
            self.header = False
            return values.slice(1)
        return values

    def close(self) -> list:
        record, self.open = "\n".join(self.open).removesuffix("\r"), []
        if self.leading:
            self.leading = False
            return [(record, *self.key, 0, False)]
        if self.header:
            self.header = False
            return []
        return [(record, None, None, None, None)]

    def rest(self) -> pa.RecordBatch:
        """What the split's end leaves open: a record's beginning, or a middle part."""
        rows = [("\n".join(self.open), *self.key, 1, not self.leading)] if self.open else []
        if rows and self.header and not self.leading:
            rows[0] = (None, *rows[0][1:])
        return pa.record_batch(
            [pa.array([r[k] for r in rows], kind) for k, kind in [(0, pa.string()), *PLACES]], COLUMNS
        )


COLUMNS = ["record", "path", "start", "place", "opens"]
PLACES = [(1, pa.string()), (2, pa.int64()), (3, pa.int32()), (4, pa.bool_())]


def joined(pieces: DataFrame) -> DataFrame:
    """``record`` of the records that cross splits, from their pieces.

    A file's pieces, two a split at most, are numbered by the records that begin; a
    record's are then put together. A header that long begins with a NULL and is left out.
    """
    so_far = (
        Window.partitionBy("path").orderBy("start", "place")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = pieces.withColumn("number", F.sum(F.col("opens").cast("int")).over(so_far))
    part = F.struct("start", "place", "record")
    parts = numbered.groupBy("path", "number").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    lost = F.raise_error(F.lit("scan splits changed between two passes over a CSV file"))
    return parts.filter(F.when(F.col("number") > 0, True).otherwise(lost.cast("boolean"))).filter(
        "parts[0].record is not null"
    ).select(F.array_join("parts.record", "\n").alias("record"))


def records_parsed(spark: SparkSession, path: str, parse: Column) -> DataFrame | None:
    """Records of the files at ``path`` as ``parse`` makes of ``record``, written once.

    None if no quoted value has a line break, so that a reader of lines will do.
    """
    with fixed_splits(spark):
        lines = lines_of(spark, path)
        states = settle(split_states(lines), "csv_states")
        if states.filter("breaks").isEmpty():
            return None
        whole = F.col("place").isNull()
        raw = F.when(~whole, F.struct("record", "path", "start", "place", "opens"))
        parsed = stitched(lines, states).select(
            F.when(whole, parse).alias("parsed"), raw.alias("piece")
        )
        written = settle(parsed, "csv_records")
    pieces = settle(joined(written.filter("piece is not null").select("piece.*")), "csv_joined")
    rest = pieces.select(parse.alias("parsed"))
    return written.filter("piece is null").select("parsed.*").unionByName(rest.select("parsed.*"))
