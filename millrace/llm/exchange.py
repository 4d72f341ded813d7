"""Exchange between chunks of documents and key buckets, for statistics too many to shuffle as one row each.

Documents are packed into compressed chunks once, in a table bucketed by chunk. In a round every chunk sends each bucket of keys one
packed request with its distinct keys; the bucket combines the requests of all chunks and sends each of them one packed reply in
the order of its request. A key that a third of all documents hold is one entry per chunk. The chunk table is never shuffled.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import shared_dir

CHUNK_BYTES = 8_000_000  # of text in a chunk; a longer text is a chunk of its own
BUCKET_BYTES = 16_000_000  # of text per key bucket
_HEAD = struct.Struct("<I")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension, byte planes apart so that small numbers compress."""
    body, head = [], [_HEAD.pack(len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode()
        head.append(struct.pack("<IB", len(a), len(code)) + code)
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.compress(b"".join(head) + b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    kinds, at = [], _HEAD.size
    for _ in range(_HEAD.unpack_from(data)[0]):
        n, size = struct.unpack_from("<IB", data, at)
        kinds.append((n, np.dtype(data[at + 5:at + 5 + size].decode())))
        at += 5 + size
    out = []
    for n, kind in kinds:
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The values (not negative) in the smallest unsigned type."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


class Chunk:
    """The documents of a chunk: ids (None allowed), flags, raw texts."""

    def __init__(self, payload: bytes):
        data = zstandard.decompress(payload)
        (n,) = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.ids = np.frombuffer(data, np.int64, n, at)
        self.null_id = np.frombuffer(data, bool, n, at + 8 * n)
        self.flag = np.frombuffer(data, bool, n, at + 9 * n)
        lengths = np.frombuffer(data, np.int64, n, at + 10 * n)
        ends = np.cumsum(lengths) + at + 18 * n
        self.texts = [data[b - k:b] for b, k in zip(ends.tolist(), lengths.tolist())]

    @staticmethod
    def packed(rows: list[tuple[int | None, bool, bytes]]) -> bytes:
        body = [_HEAD.pack(len(rows)), np.array([r[0] or 0 for r in rows], np.int64).tobytes(), np.array([r[0] is None for r in rows], bool).tobytes(),
                np.array([bool(r[1]) for r in rows], bool).tobytes(), np.array([len(r[2]) for r in rows], np.int64).tobytes(), *[r[2] for r in rows]]
        return zstandard.compress(b"".join(body), 3)

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.null_id)


def chunk_table(docs: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The chunks of docs (doc_id long, flag boolean, text binary), and the total length of the texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([size], pa.int64()), pa.array([Chunk.packed(rows)], pa.binary())],
                                              names=["chunk", "size", "payload"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for row in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist()):
                    rows.append(row)
                    size += len(row[2])
                    if size >= CHUNK_BYTES:
                        yield made()
                        k, rows, size = k + 1, [], 0
        if rows:
            yield made()

    spark = docs.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (docs.select("doc_id", "flag", "text").mapInArrow(cut, "chunk long, size long, payload binary")
     .write.format("parquet").option("path", shared_dir(spark, label)).bucketBy(n, "chunk").saveAsTable(name))
    chunks = spark.table(name)
    return chunks.select("chunk", "payload"), chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def bucket_count(size: int) -> int:
    """Key buckets in proportion to the texts, a power of two."""
    return 1 << max(2, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))


REQUEST = "bucket long, chunk long, blob binary"
REPLY = "chunk long, bucket long, blob binary"
Rows = Iterable[tuple]


def _batch(rows: Rows, schema: pa.Schema) -> pa.Table:
    rows = list(rows)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def first_requests(chunks: DataFrame, ask: Callable[[Chunk], Rows]) -> DataFrame:
    """Requests of every chunk: `ask` gives (bucket, blob) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, payload = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                yield from _batch(((b, chunk, blob) for b, blob in ask(Chunk(payload))), _schema(REQUEST)).to_batches()

    return chunks.mapInArrow(run, REQUEST)


def answered(requests: DataFrame, combine: Callable[[int, list[int], list[bytes]], Rows]) -> DataFrame:
    """Replies of every bucket: `combine` gets its number, the chunks and their requests, and gives (chunk, blob) pairs. A bucket holds
    one entry per chunk and distinct key of its share."""

    def run(key, table):
        bucket = key[0].as_py()
        rows = combine(bucket, table.column("chunk").to_pylist(), table.column("blob").to_pylist())
        return _batch(((chunk, bucket, blob) for chunk, blob in rows), _schema(REPLY))

    return requests.groupBy("bucket").applyInArrow(run, REPLY)


def with_replies(chunks: DataFrame, replies: DataFrame, go_on: Callable, ddl: str) -> DataFrame:
    """`go_on(chunk number, chunk, {bucket: reply})` for every chunk; it gives an Arrow table of the DDL's columns."""

    def run(left, right):
        got = dict(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist()))
        return go_on(left.column("chunk")[0].as_py(), Chunk(left.column("payload")[0].as_py()), got)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, ddl)
