"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

One file row is a *block* of whole documents, a few million ids, that can be
decoded alone:

``ranks``    ids of the block by falling frequency (ties: smaller id first), uint32
``control``  one byte for four ids, two bits each: number of data bytes less one
``data``     the ids' ranks, 1 to 4 little-endian bytes each
``doc_ids``, ``null_ids``, ``sizes``  the documents, in ascending doc_id order

The commonest ids of a block take one byte. A block's ranks count all ids of all
its documents and are stored with it, so one pass over the corpus writes the
files and no table of the whole vocabulary has to be agreed on first; the table
costs about 1 % of a full block. Control bytes lie apart from the data, so a
table of 256 entries gives the lengths of four ids at a time and the decoder
needs no loop over ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm import shared, tokens

FILE_SCHEMA = "shard int, block int, shard_start long, n_ids long, doc_ids binary, null_ids binary, sizes binary, ranks binary, control binary, data binary"
#: Number of data bytes of each of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        size += ranks >= 1 << bits
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers again, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def encode_block(ids: np.ndarray) -> dict[str, bytes]:
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    order = used[np.argsort(-counts[used], kind="stable")].astype("<u4")
    rank_of = np.zeros(len(counts), "<u4")
    rank_of[order] = np.arange(len(order), dtype="<u4")
    control, data = encode_ranks(rank_of[ids])
    return {"ranks": order.tobytes(), "control": control, "data": data}


def decode_block(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranks, "<u4")[decode_ranks(control, data, n)]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = 2_000_000, memo: bool = True) -> None:
    """Writes the id files of ``docs`` to ``path`` in ascending doc_id order.

    ``end_id`` follows every document. A null text counts as empty; null
    doc_ids come first; rows of equal doc_id lie in text order and repeated rows
    stay repeated. Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives a table of no blocks.

    One range shuffle of the texts, with no group to hold: a task keeps a
    block's ids and a few megabytes of text. Ranges are of doc_id and the
    beginning of the text, so rows of one doc_id (or of none) are cut too; only
    rows that share both lie in one task, which streams through them.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of = tokens.opened(vocabulary, memo)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, held, size
            names, sizes, ids = (np.concatenate(x) for x in ([x[0] for x in held], [x[2] for x in held], [x[3] for x in held]))
            nulls = np.concatenate([x[1] for x in held])
            row = {"shard": shard, "block": number, "shard_start": start, "n_ids": len(ids), "doc_ids": names.astype("<i8").tobytes(), "null_ids": np.packbits(nulls).tobytes(), "sizes": sizes.astype("<u4").tobytes()} | encode_block(ids)
            number, start, held, size = number + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            key, body = batch.column(0), batch.column(1)
            lengths = np.nan_to_num(pa.compute.binary_length(body).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in tokens.slices(lengths.tolist()):
                ids, offsets = tokens.with_end(*memo_of.encode(body.slice(a, b - a)), end_id)
                names = key.slice(a, b - a)
                held.append((names.fill_null(0).to_numpy(zero_copy_only=False), names.is_null().to_numpy(zero_copy_only=False), np.diff(offsets), ids))
                size += len(ids)
                if size >= block_ids:
                    yield flush()
        if held:
            yield flush()

    ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), *((x, pa.binary()) for x in ("doc_ids", "null_ids", "sizes", "ranks", "control", "data"))])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Documents of id files: doc_id, start, n_tokens, ids_crc32, shard.

    ``start`` counts the ids of all documents before it.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ids = decode_block(row["ranks"], row["control"], row["data"], row["n_ids"])
                ends = np.cumsum(sizes)
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(sizes)).astype(bool)
                crcs = [tokens.crc(ids[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null), pa.array(np.full(len(sizes), row["shard"], np.int32)), pa.array(row["shard_start"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], schema=schema)

    # One row a shard: as many as the writer had tasks.
    totals = files.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_ids")).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = files.mapInArrow(documents, "doc_id long, shard int, local long, n_tokens long, ids_crc32 long")
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard")


def ids_of(spark, path: str) -> DataFrame:
    """Whole id lists: doc_id, ids array<long>."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ids = decode_block(row["ranks"], row["control"], row["data"], row["n_ids"]).astype(np.int64)
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(sizes)).astype(bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null), lists], names=["doc_id", "ids"])

    return files.mapInArrow(documents, "doc_id long, ids array<long>")


def through_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes ``docs`` as id files in the shared folder and reads them back."""
    path = shared.new_path(docs.sparkSession, "idfiles")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path).drop("shard")
