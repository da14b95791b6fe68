"""PNG images in binary columns, and cosine-transform hashes of their pixels.

An image is 8-bit grey. The encoder and decoder are written out here: chunks
with their CRC-32, zlib for the pixel stream, and all five scan-line filters.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.llm import shared, tokens

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Texts are laid out on rows of this many pixels; three rows are 576 bytes.
WIDTH, UNIT = 192, 576


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predicted(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Paeth's choice among left, above and upper left (int16)."""
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def filtered(pixels: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """Scan lines with their filter bytes. ``kinds``: filter 0 to 4 of each row.

    None takes, row by row, the filter of the least sum of absolute differences.
    """
    height, width = pixels.shape
    x = pixels.astype(np.int16)
    a, b, c = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    a[:, 1:], b[1:], c[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    ways = (lambda r: x[r], lambda r: x[r] - a[r], lambda r: x[r] - b[r], lambda r: x[r] - (a[r] + b[r]) // 2, lambda r: x[r] - _predicted(a[r], b[r], c[r]))
    if kinds is None:
        every = [way(slice(None)) & 255 for way in ways]
        kinds = np.argmin([np.minimum(y, 256 - y).sum(1) for y in every], axis=0)
    out = np.zeros((height, width + 1), np.uint8)
    out[:, 0] = kinds
    for kind in np.unique(kinds):
        out[kinds == kind, 1:] = ways[kind](kinds == kind) & 255
    return out.tobytes()


def flat_kinds(pixels: np.ndarray) -> np.ndarray:
    """Filter of each row where most pixels equal the one to the left (Sub) or
    above (Up), as in what fills a text's last rows and in repeated lines. Other
    rows of text only grow by prediction and take none."""
    left, above = np.zeros(len(pixels)), np.zeros(len(pixels))
    left[:] = (pixels[:, 1:] == pixels[:, :-1]).mean(1)
    above[1:] = (pixels[1:] == pixels[:-1]).mean(1)
    return np.where(np.maximum(left, above) <= 0.5, 0, np.where(left >= above, 1, 2))


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Pixels of scan lines (uint8 of (height, width + 1))."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    # Rows of Sub hang on no other row; the others follow in order.
    out[kinds == 1] = np.cumsum(out[kinds == 1], axis=1, dtype=np.uint8)
    for i in np.flatnonzero(kinds > 1):
        above = out[i - 1] if i else np.zeros(out.shape[1], np.uint8)
        if kinds[i] == 2:
            out[i] += above
        else:  # each pixel needs the one before it
            row, up, left, corner = out[i].tolist(), above.tolist(), 0, 0
            for j, (v, b) in enumerate(zip(row, up, strict=True)):
                if kinds[i] == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = left if da <= db and da <= dc else b if db <= dc else corner
                left = row[j] = (v + guess) & 255
                corner = b
            out[i] = row
    return out


def encode(pixels: np.ndarray, level: int = 6, kinds: np.ndarray | None = None) -> bytes:
    height, width = pixels.shape
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(pixels, kinds), level)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey PNG; ValueError if a chunk is damaged or missing."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(png) and not ended:
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"damaged PNG chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
        elif kind[0] < 97:
            raise ValueError(f"unknown critical PNG chunk {kind!r}")
        at += 12 + n
    if head is None or not ended:
        raise ValueError("PNG without header or end")
    width, height, *rest = head
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit grey without interlacing is read")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"damaged PNG pixels: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("PNG has a wrong number of pixels")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(low)[:, None])


def _areas(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (excluded) pixel of each of ``size`` cells along n pixels."""
    first = np.arange(size) * n // size
    return first, np.maximum(first + 1, (np.arange(size) + 1) * n // size)


def cosine_hash(pixels: np.ndarray, size: int = 32, low: int = 8) -> str:
    """Hash of the low frequencies: mean over size x size cells, DCT-II, and a
    bit for each of the low x low coefficients above their median."""
    height, width = pixels.shape
    total = np.zeros((height + 1, width + 1), np.int64)
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    (t, b), (l, r) = _areas(height, size), _areas(width, size)
    sums = total[b][:, r] - total[t][:, r] - total[b][:, l] + total[t][:, l]
    cells = sums / ((b - t)[:, None] * (r - l)[None, :])
    basis = _cosines(size, low)
    # Rounded, so that the order of additions cannot turn a bit.
    found = np.round(basis @ cells @ basis.T, 6).reshape(-1)
    bits = found > np.median(found[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def text_pixels(text: str | None) -> tuple[np.ndarray, int]:
    """A text's UTF-8 bytes as pixels, filled with 255 to a positive multiple of
    576, and the number of bytes before that."""
    data = (text or "").encode()
    fill = -len(data) % UNIT if data else UNIT
    return np.frombuffer(data + b"\xff" * fill, np.uint8).reshape(-1, WIDTH), len(data)


def _mapped(rows: DataFrame, schema: str, each: Callable[[list], list[tuple]], body: int, most: int = 4_000_000) -> DataFrame:
    """Rows of ``each`` over slices of about ``most`` bytes of column ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.nan_to_num(pa.compute.binary_length(batch.column(body)).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in tokens.slices(lengths.tolist(), most):
                rows_in = list(zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(batch.num_columns)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*each(rows_in), strict=True), kinds, strict=True)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", level: int = 6) -> DataFrame:
    """doc_id, n_bytes and the text as a PNG in the binary column ``media``.

    Rows are filtered by :func:`flat_kinds`. A null or empty text gives an image of 576 pixels of 255;
    null doc_ids and repeated rows stay; other columns are ignored; an empty
    table gives no rows.
    """

    def each(rows: list[tuple]) -> list[tuple]:
        out = []
        for key, body in rows:
            pixels, n = text_pixels(body)
            out.append((key, n, encode(pixels, level, flat_kinds(pixels))))
        return out

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _mapped(rows, "doc_id long, n_bytes long, media binary", each, 1)


def features(stored: DataFrame) -> DataFrame:
    """Digests and the cosine hash of images as :func:`store` gives them."""

    def each(rows: list[tuple]) -> list[tuple]:
        out = []
        for key, n, png in rows:
            pixels = decode(png)
            payload = pixels.tobytes()
            out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels)))
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _mapped(stored.select("doc_id", "n_bytes", "media"), schema, each, 2, 1_000_000)


def through_media(docs: DataFrame) -> DataFrame:
    """Stores all texts as images in a shared table and reads them back."""
    return features(shared.written(store(docs), "media", codec="uncompressed"))
