"""Texts in chunks, and packed exchanges of 64-bit keys between chunks.

A chunk is a row with a few MB of texts.  Each chunk sends its distinct keys,
one binary value for each bucket of the hash space, to the bucket's task, which
sees a key's chunks together and replies with one number per key in the order
in which they were sent.  What is shuffled is a few large binaries instead of a
row per key, and a task's memory is bounded by the bucket, whatever a key's
frequency: a chunk sends a key once.  A chunk goes over the buckets in which it has
keys alone, so its work and rows are at most its keys, however many buckets the
input's size makes: with few keys a bucket the exchange is a row a key, never more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import lean, materialise

CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 60_000
BUCKET_KEYS = 1_000_000  # keys a bucket's task should get

FEW = 32  # so many numbers or fewer are sent as they are

CHUNKS = "chunk long, n_docs int, n_bytes long, ids binary, sizes binary, texts binary"
SENT = "chunk long, bucket int, blob binary"


def squeeze(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers take no room.  The first byte tells a few plain numbers."""
    import zstandard

    if len(x) <= FEW:
        return b"\0" + np.ascontiguousarray(x).tobytes()
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    if blob[:1] == b"\0":
        return np.frombuffer(blob, dtype, offset=1) if len(blob) > 1 else np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def make(docs: DataFrame, tag: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of chunks in the shared folder; which ids are null is kept beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        base, count = TaskContext.get().partitionId() << 20, 0
        press = zstandard.ZstdCompressor(level=3)
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> pa.RecordBatch:
            nonlocal count
            ids, none, sizes, data = (np.concatenate(x) for x in zip(*held))
            held.clear()
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([base + count]), pa.array([len(ids)], pa.int32()), pa.array([len(data)], pa.int64())] + [pa.array([x], pa.binary()) for x in (join_blobs(squeeze(ids), squeeze(np.packbits(none))), squeeze(sizes), press.compress(data.tobytes()))],
                names=["chunk", "n_docs", "n_bytes", "ids", "sizes", "texts"],
            )

        for batch in batches:
            data, offs = _text.buffers(batch.column("text"))
            column = batch.column("doc_id")
            none, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in _text.slices(offs, CHUNK_BYTES // 2):
                held.append((ids[lo:hi].astype(np.int64), none[lo:hi], np.diff(offs[lo : hi + 1]), data[offs[lo] : offs[hi]].copy()))
                if sum(len(h[3]) for h in held) >= CHUNK_BYTES // 2 or sum(len(h[0]) for h in held) >= CHUNK_DOCS:
                    yield close()
        if held:
            yield close()

    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), CHUNKS), tag, "uncompressed")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which of them are null, bytes, offsets)"""
    import zstandard

    sizes = expand(row["sizes"], np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(row["n_bytes"])), np.uint8)
    ids, none = split_blobs(row["ids"])
    return expand(ids, np.int64), np.unpackbits(expand(none, np.uint8), count=len(sizes)).astype(bool), data, np.concatenate([[0], np.cumsum(sizes)])


def buckets(chunks: DataFrame, share: float = 1.0) -> int:
    """So many that a task gets about BUCKET_KEYS keys; ``share`` of the words become keys."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, total * share / 5 / BUCKET_KEYS, 1))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """By the high 32 bits; the low ones are left to tell keys of a bucket apart."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def ranges(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """(bucket, its range) of the buckets in which sorted keys lie."""
    b = bucket_of(keys, n)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    return [(k, slice(lo, hi)) for k, lo, hi in zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(b)])]


def send(chunk: int, keys: np.ndarray, n: int, pack: Callable[[np.ndarray, slice], bytes]) -> list[tuple[int, int, bytes]]:
    """Rows for sorted distinct ``keys``; ``pack(keys of the bucket, their range)`` makes the blob."""
    return [(chunk, k, pack(keys[own], own)) for k, own in ranges(keys, n)]


def sent_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["chunk", "bucket", "blob"])


def sent_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([sent_batch(rows)])


def filter_bits(chunks: DataFrame, share: float = 1.0) -> int:
    """Leading bits by which under 1 % of different keys look alike, whatever the input's size."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return int(min(64, max(24, np.ceil(np.log2(max(total * share / 5, 1))) + 7)))


def lead(keys: np.ndarray, bits: int) -> np.ndarray:
    """The sorted distinct leading ``bits`` of sorted keys; buckets cut them at the same places."""
    return keys >> np.uint64(64 - bits)


def steps(x: np.ndarray) -> bytes:
    """Increasing numbers as their squeezed differences."""
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def unsteps(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def join_blobs(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_blobs(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def by_chunk(left: DataFrame, *replies: DataFrame) -> DataFrame:
    """Rows (chunk, kind, bucket, blob, ...) of a chunk and of all replies to it, for groupBy("chunk")."""
    none = {"n_docs": "int", "n_bytes": "long", "ids": "binary", "sizes": "binary", "texts": "binary"}
    out = left.select("chunk", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob"), *none)
    for k, r in enumerate(replies, 1):
        out = out.unionByName(r.select("chunk", F.lit(k).alias("kind"), "bucket", "blob", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))
    return out


def group(t: pa.Table, kinds: int) -> tuple[int, dict | None, list[dict[int, bytes]]]:
    """(chunk, the chunk's row, for each kind of reply its blobs by bucket) of one group of by_chunk."""
    row, out = None, [{} for _ in range(kinds)]
    kind, bucket = t.column("kind").to_pylist(), t.column("bucket").to_pylist()
    for k in range(t.num_rows):
        if kind[k] == 0:
            row = {c: t.column(c)[k].as_py() for c in ("n_docs", "n_bytes", "ids", "sizes", "texts")}
        else:
            out[kind[k] - 1][bucket[k]] = t.column("blob")[k].as_py()
    return t.column("chunk")[0].as_py(), row, out
