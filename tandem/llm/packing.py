"""Packing: concatenate all documents and cut the stream into sequences of a fixed number of tokens.

Two passes. The first encodes every document once and writes, in the shared folder, its ids with the number of tokens
before it in its partition. The totals per partition give, by a prefix sum over one row per partition, the place of
every partition in the global stream. The second pass cuts: a document at place p with n tokens lies in the sequences
p // size to (p + n - 1) // size, one boundary record per sequence. No task sees more than its partition, and only the
last sequence is shorter than the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.encoding import byte_encoder
from tandem.llm.store import written

END_ID = 1
SEQUENCE = 2048
CHUNK = 256  # documents encoded at a time within an Arrow batch


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                tail = np.array([end_id], encoder.width).tobytes()
                ids = [x + tail for x in encoder.encode(rows.column("text").to_pylist())]
                sizes = np.array([len(x) for x in ids], np.int64) // encoder.width.itemsize
                places = before + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(places.astype(np.int64)), rows.column("doc_id"),
                     pa.array(sizes), pa.array(ids, pa.binary())],
                    names=["part", "place", "doc_id", "doc_tokens", "ids"],
                )

    return run


def _cut(size: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("base").to_numpy() + batch.column("place").to_numpy()
            tokens = batch.column("doc_tokens").to_numpy()
            first, last = place // size, (place + tokens - 1) // size
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            sequence = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
            begin = np.maximum(sequence * size, place[row])
            end = np.minimum((sequence + 1) * size, place[row] + tokens[row])
            start = begin - place[row]
            ids, crcs = batch.column("ids"), np.empty(len(row), np.int64)
            seen, wide = -1, b""
            for k, (r, a, b) in enumerate(zip(row.tolist(), start.tolist(), (end - place[row]).tolist())):
                if r != seen:
                    seen, wide = r, np.frombuffer(ids[r].as_buffer(), width).astype("<u4").tobytes()
                crcs[k] = zlib.crc32(wide[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(crcs),
                 pa.array(tokens[row]), pa.array(sequence), pa.array(begin - sequence * size)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have one token, the end id. Repeated rows are packed as often as they occur. An empty table
    has no pieces. Other columns of ``docs`` are not read. The order of the stream is the order of the rows in the
    input's partitions.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = "<u2" if byte_encoder(vocabulary).width.itemsize == 2 else "<u4"
    rows = docs.select("doc_id", "text").mapInArrow(
        _encoded(vocabulary, end_id), f"part int, place bigint, doc_id {kind}, doc_tokens bigint, ids binary"
    )
    stored = written(rows, "packing")
    totals = stored.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(bases), "part")  # as many rows as the input has partitions
    return placed.select("base", "place", "doc_id", "doc_tokens", "ids").mapInArrow(
        _cut(size, width),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
