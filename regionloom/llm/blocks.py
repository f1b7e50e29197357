"""Texts dealt into blocks of bounded size, kept as a bucketed table, and questions between blocks.

A block is a few megabytes of whole texts. The table is bucketed by block, so a pass over it, also
one that joins answers by block, moves no text. Blocks ask about 64-bit keys: each sends its sorted
distinct keys to the buckets of the key space that hold them, every bucket combines what all blocks
sent, and its answer goes back aligned with what each block sent. A key that a third of all texts
share counts once per block.

Growth. A block and a bucket stay of one size, whatever the input. There are `LEAST_BUCKETS` buckets
until that takes more than their share of the keys each, so messages grow with the number of blocks;
beyond, a message holds fewer keys, and as empty ones are not sent there are never more messages than
keys: at worst the exchange is a plain shuffle of (key, block). The table has at most `TABLE_BUCKETS`
buckets, each of them with more blocks then; a task still holds one block at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from .common import shared_dir

BLOCK_BYTES = 4 << 20
LEAST_BUCKETS = 128
TABLE_BUCKETS = 50_000  # Spark refuses tables of more than 100,000


def bucket_count(n_bytes: int, bucket_bytes: int) -> int:
    """Buckets of the key space for texts of n_bytes, if a bucket can hold the keys of bucket_bytes of text."""
    return max(LEAST_BUCKETS, -(-n_bytes // bucket_bytes))


def block_count(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(8, -(-n_bytes // block_bytes))


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes (8-byte little-endian count first)."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def expand(b: bytes, kind) -> np.ndarray:
    n, item = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(b[8:], decompressed_size=n * item, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(item, n).T).view(kind).reshape(n)


def differences(a: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """What each number is above the one before it; a number that a part begins with (at `starts`, else the first) stays."""
    out = a.copy()
    out[1:] -= a[:-1]
    if starts is not None:
        out[starts] = a[starts]
    return out


def squeeze_sorted(a: np.ndarray) -> bytes:
    """An ascending uint64 array by its differences."""
    return squeeze(differences(a))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.uint64), dtype=np.uint64)


def squeeze_keys(a: np.ndarray) -> bytes:
    """An ascending uint64 array of hashes by its differences, each byte plane by itself: those of noise stay as they are, a few
    percent shorter than all planes in one frame.
    """
    planes = np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(len(a), 8).T)
    head, body = [len(a)], b""
    for p in planes:
        raw = p.tobytes() if p.any() else b""
        packed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        head.append(len(packed) if len(packed) < len(raw) else len(raw))
        body += packed if len(packed) < len(raw) else raw
    return np.array(head, np.uint32).tobytes() + body


def expand_keys(b: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(b[:36], np.uint32).tolist()
    planes, at = np.zeros((8, n), np.uint8), 36
    for k, size in enumerate(sizes):
        if size:
            part = b[at : at + size]
            planes[k] = np.frombuffer(part if size == n else pa.decompress(part, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
            at += size
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(n), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where in ascending keys each of `buckets` equal parts of the key space begins, and the end."""
    marks = np.array([-(-(i << 64) // buckets) for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, marks), [len(keys)]]).astype(np.int64)


def _blob(rows: pa.Table, level: int | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    codec = pa.Codec("zstd", compression_level=level) if level else "zstd"
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        w.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _saved(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows (block, blob) as a table bucketed by block, whose name is gone again."""
    spark = packed.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    try:
        writer = packed.write.bucketBy(buckets, "block").sortBy("block").format("parquet")
        writer.option("compression", "none").option("path", path).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # an external table: the files stay for who reads it


def store(rows: DataFrame, block: Column, n_blocks: int, shrink=None, most: int = TABLE_BUCKETS) -> DataFrame:
    """`rows` packed by block: (block, blob), a table of at most `most` buckets in the shared folder.

    `shrink` may merge the rows (an Arrow table) of one batch before they are dealt.
    """
    names, buckets = rows.columns, min(n_blocks, most)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = shrink(rows) if shrink else rows
            at = rows.column("_block").to_numpy()
            order = np.argsort(at, kind="stable")
            sorted_rows = rows.select(names).take(pa.array(order))
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            blobs = [_blob(sorted_rows.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays([pa.array(at[order][cuts], pa.int64()), pa.array(blobs, pa.binary())], ["block", "blob"])

    packed = rows.withColumn("_block", block.cast("long")).mapInArrow(pack, "block long, blob binary")
    return _saved(packed.repartition(buckets, "block"), buckets)


def store_as_read(rows: DataFrame, n_blocks: int, block_bytes: int, most: int = TABLE_BUCKETS, level: int | None = None) -> DataFrame:
    """`rows` (with a text column) packed as they come, about block_bytes of text a block: a table as of `store`.

    No text is shuffled: a block is named by the task that packs it and stays whole in one bucket. `level`: of its compression.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            out = [pa.array([task << 32 | made], pa.int64()), pa.array([_blob(pa.Table.from_batches(held), level)], pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["block", "blob"])

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            a = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= block_bytes:
                    held.append(batch.slice(a, i + 1 - a))
                    yield flush()
                    held, size, made, a = [], 0, made + 1, i + 1
            if a < batch.num_rows:
                held.append(batch.slice(a))
        if held:
            yield flush()

    return _saved(rows.mapInArrow(pack, "block long, blob binary"), min(n_blocks, most))


def unpack(table: pa.Table) -> pa.Table | None:
    """The rows of a block's blobs."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("blob") if x.is_valid]
    return pa.concat_tables(parts) if parts else None
