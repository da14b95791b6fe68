"""Harmonic packing of documents into token sequences.

A piece of length l belongs to class k = capacity // l: it lies in
(capacity/(k+1), capacity/k], and a bin of class k takes exactly k pieces. No
bin is ever searched, so each task packs what it reads without a shuffle and
without knowing of others. Plain harmonic packing leaves up to half a bin
empty; documents may be cut, so a remainder that would waste more than
``waste`` of its bin is cut at the reciprocal of capacity just below it, k of
which fill a bin, and the rest is classed in its turn (``cuts`` times at most).
Pieces beyond class ``classes`` - the small items that harmonic packing leaves
to next-fit - and, when a task ends, the bins that lack pieces, form one stream
that is cut at full sequences; its end is cut into sequences of powers of two,
which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.llm import tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cut_lengths(n: int, capacity: int, waste: float = 0.02, cuts: int = 2) -> list[int]:
    """Lengths into which a document of ``n`` tokens is cut."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(cuts):
        if rest == 0 or capacity // rest * rest >= capacity * (1 - waste):
            break
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


class Packer:
    """Packs one task's documents; rows of :data:`NAMES` come out as bins close."""

    def __init__(self, capacity: int, worker: int, classes: int = 32, waste: float = 0.02, cuts: int = 2):
        self.capacity, self.classes, self.waste, self.cuts = capacity, classes, waste, cuts
        self.next_id = worker << 36
        self.open: dict[int, list] = {}
        self.stream: list = []
        self.held = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), tokens.crc(ids), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _pour(self, piece: tuple) -> None:
        self.stream.append(piece)
        self.held += len(piece[3])
        while self.held >= self.capacity:
            self._close(self._draw(self.capacity))

    def _draw(self, size: int) -> list:
        """The first ``size`` tokens of the stream."""
        out = []
        self.held -= size
        while size:
            doc_id, start, total, ids = self.stream[0]
            n = min(size, len(ids))
            out.append((doc_id, start, total, ids[:n]))
            if n == len(ids):
                self.stream.pop(0)
            else:
                self.stream[0] = (doc_id, start + n, total, ids[n:])
            size -= n
        return out

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        for n in cut_lengths(len(ids), self.capacity, self.waste, self.cuts):
            piece = (doc_id, start, len(ids), ids[start : start + n].copy())
            start += n
            if (k := self.capacity // n) > self.classes:
                self._pour(piece)
                continue
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        for k in sorted(self.open):
            for piece in self.open[k]:
                self._pour(piece)
        self.open = {}
        while self.held:
            self._close(self._draw(1 << (self.held.bit_length() - 1)))


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", classes: int = 32, waste: float = 0.02, cuts: int = 2, memo: bool = True) -> DataFrame:
    """One row for each piece of each document; columns as in :data:`SCHEMA`.

    A null text counts as empty (one piece: the end id); a null doc_id is kept;
    repeated rows are packed as often as they come; a text of any length is cut
    into as many pieces as it needs; other columns are ignored. An empty table
    gives no rows. ``offset`` is gapless from 0 in each sequence. All sequences
    hold at most ``capacity`` tokens. ``capacity`` is to be a power of two if
    the last sequences of a task are to need no padding.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of, packer = tokens.opened(vocabulary, memo), Packer(capacity, TaskContext.get().partitionId(), classes, waste, cuts)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(NAMES)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=NAMES)

        for batch in batches:
            key, body = batch.column(0).to_pylist(), batch.column(1)
            lengths = np.nan_to_num(pa.compute.binary_length(body).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in tokens.slices(lengths.tolist()):
                ids, offsets = tokens.with_end(*memo_of.encode(body.slice(a, b - a)), end_id)
                for i in range(a, b):
                    packer.add(key[i], ids[offsets[i - a] : offsets[i - a + 1]])
                yield out()
        packer.finish()
        yield out()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(packed, SCHEMA)
