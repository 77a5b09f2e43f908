"""What the operators on text share: tables, chunks of Arrow batches, packed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python objects or number arrays at a time.
CHUNK_BYTES = 2_000_000

#: Bytes of text in a block of documents that is gathered in one group.
BLOCK_BYTES = 8_000_000

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string"


def table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The columns of ``schema``, cast to it; other columns are left out."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return typed(df, schema)


def typed(df: DataFrame, schema: str) -> DataFrame:
    """``df`` narrowed to the columns of ``schema`` and cast to their types."""
    fields = [part.split() for part in schema.split(",")]
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in fields))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts of ``df``, which sizes blocks and shards."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards_for(size: int, each: int, least: int = 8) -> int:
    """A power of two of shards, so that a shard has at most about ``each`` of ``size``."""
    return max(least, 1 << max(0, (size - 1) // each).bit_length())


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with up to ``limit`` bytes in ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        upto = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = int(np.searchsorted(upto, before + limit, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def pack_batch(batch: pa.RecordBatch | pa.Table) -> bytes:
    """A batch as Arrow stream bytes, compressed as one, after their number.

    A stream that compresses each buffer of each column takes twice the time for small ones.
    """
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write(batch)
    stream = sink.getvalue()
    return stream.size.to_bytes(8, "little") + pa.compress(stream, "zstd", asbytes=True)


def unpack_batch(payload: bytes, columns: list[str] | None = None) -> pa.Table:
    """The packed rows, only some of their columns if named."""
    size = int.from_bytes(payload[:8], "little")
    stream = pa.decompress(pa.py_buffer(payload).slice(8), size, "zstd")
    rows = pa.ipc.open_stream(stream, options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()
    return rows if columns is None else rows.select(columns)


def unpack_all(payloads: pa.ChunkedArray | pa.Array) -> pa.Table | None:
    """The rows of all packed batches of a column, None if there are none."""
    tables = [unpack_batch(x) for x in payloads.to_pylist()]
    return pa.concat_tables(tables) if tables else None


def pack_by(shard: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Rows of number columns as one packed row for each shard: shard, payload.

    The order of the rows is kept within a shard.
    """
    if not len(shard):
        return None
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    parts = np.split(order, cuts)
    payloads = [
        pack_batch(pa.record_batch({k: pa.array(v[part]) for k, v in columns.items()}))
        for part in parts
    ]
    ids = pa.array([int(shard[part[0]]) for part in parts], pa.int32())
    return pa.record_batch({"shard": ids, "payload": pa.array(payloads, pa.binary())})


PACKED = "shard int, payload binary"


def pack_blocks(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """The rows of ``df`` in compressed pieces by block of ``key``: shard, payload.

    Shuffling these moves whole rows at their compressed size. A row without a
    key goes to a block by its text's hash, so that such rows spread.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", BLOCK_BYTES):
            at = part.schema.get_field_index("__block")
            shard = part.column(at).to_numpy(zero_copy_only=False)
            rest = part.drop_columns(["__block"])
            order = np.argsort(shard, kind="stable")
            runs = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
            payloads = [pack_batch(rest.take(pa.array(run))) for run in runs]
            yield pa.record_batch({
                "shard": pa.array([int(shard[run[0]]) for run in runs], pa.int32()),
                "payload": pa.array(payloads, pa.binary()),
            })

    spread = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")
    block = F.coalesce(block_of(key, blocks), spread)
    return df.withColumn("__block", block).mapInArrow(pack, PACKED)


def block_of(key: str, blocks: int):
    """The block of a long key, null for null."""
    mixed = F.col(key).bitwiseXOR(F.shiftrightunsigned(key, 7))
    return F.pmod(mixed, F.lit(blocks)).cast("int")


def block_numbers(keys: np.ndarray, blocks: int) -> np.ndarray:
    """As ``block_of``, for an array of int64 keys."""
    mixed = keys ^ (keys.view(np.uint64) >> np.uint64(7)).view(np.int64)
    return np.mod(mixed, blocks).astype(np.int32)


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the one of SplitMix64) over uint64 numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x
