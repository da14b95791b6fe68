"""Fingerprints from prefix polynomial hashes.

The hash of a prefix c_0 ... c_(i-1) is the sum of c_j B^j, modulo two primes
near 2^31. Two arrays of prefix hashes answer whether any two spans are equal in
constant time (the difference of two prefixes, scaled to a common power of B),
and so the longest common extension of two positions by binary search.

A fingerprint samples both arrays: hashes of the prefixes and of the suffixes
whose length is a multiple of 2^k, k least so that at most ``SAMPLES`` of each
are kept. Multiples of the larger step of two fingerprints are in both, and
equality of prefixes is monotone, so binary search finds the longest common
prefix and suffix to within a step. Their share of the longer text is the
likeness: 1 for equal texts, about 2/3 if the last third was replaced, 0 for
texts that neither begin nor end alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm import tokens

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
SAMPLES = 128
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """B^0 ... B^n for both primes, grown by doubling and kept."""
    if not _tables:
        _tables.extend(np.ones(1, np.uint64) for _ in PRIMES)
    for i, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        while len(_tables[i]) <= n:
            have = _tables[i]
            _tables[i] = np.concatenate([have, have * np.uint64(pow(base, len(have), p)) % np.uint64(p)])
    return _tables


class PrefixHash:
    """Prefix hash arrays of one text (or array of code points)."""

    def __init__(self, text: str | np.ndarray):
        self.points = np.frombuffer(text.encode("utf-32-le"), "<u4") if isinstance(text, str) else text
        self.n = len(self.points)
        self.sums = []
        for p, powers in zip(PRIMES, _powers(self.n), strict=True):
            sums = np.zeros(self.n + 1, np.uint64)
            # At most 2^32 terms below 2^31 fit.
            np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * powers[: self.n] % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def raw(self, a: np.ndarray | int, b: np.ndarray | int) -> list[np.ndarray]:
        """Hashes of spans [a, b), times B^a."""
        return [(s[b] + np.uint64(p) - s[a]) % np.uint64(p) for s, p in zip(self.sums, PRIMES, strict=True)]

    def span(self, a: int, b: int) -> int:
        """Hash of a span, the same wherever the span lies."""
        out = 0
        for p, base, raw in zip(PRIMES, BASES, self.raw(a, b), strict=True):
            out = out << 32 | int(raw) * pow(base, -a, p) % p
        return out

    def same(self, a: int, other: PrefixHash, b: int, length: int) -> bool:
        return a + length <= self.n and b + length <= other.n and self.span(a, a + length) == other.span(b, b + length)

    def common_extension(self, a: int, other: PrefixHash, b: int) -> int:
        """Length of the longest common span that starts at a and b."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(a, other, b, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def samples(self, count: int = SAMPLES) -> tuple[int, np.ndarray, np.ndarray]:
        """k, and the hashes of prefixes and suffixes of lengths 2^k, 2 * 2^k, ..."""
        k = max(0, (max(self.n - 1, 0) // count).bit_length())
        lengths = np.arange(1 << k, self.n + 1, 1 << k)
        heads, tails = (np.zeros(len(lengths), np.uint64) for _ in range(2))
        for i, (head, tail) in enumerate(zip(self.raw(0, lengths), self.raw(self.n - lengths, self.n), strict=True)):
            p = PRIMES[i]
            # To the common power B^0: times B^-(n - length) = B^-n B^length.
            back = np.uint64(pow(BASES[i], -self.n, p)) * _powers(self.n)[i][lengths] % np.uint64(p)
            heads = heads << np.uint64(32) | head
            tails = tails << np.uint64(32) | tail * back % np.uint64(p)
        return k, _folded(heads), _folded(tails)


def _folded(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each, mixed: a fingerprint has many, so each may be short."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def fingerprint(hashed: PrefixHash) -> str:
    """Text form: n, k and the whole text's hash, then prefix and suffix samples."""
    k, heads, tails = hashed.samples()
    return f"{hashed.n:x}.{k:x}.{hashed.span(0, hashed.n):016x}.{heads.astype('>u4').tobytes().hex()}.{tails.astype('>u4').tobytes().hex()}"


def parse(mark: str) -> tuple[int, int, str, np.ndarray, np.ndarray]:
    n, k, whole, heads, tails = mark.split(".")
    return int(n, 16), int(k, 16), whole, *(np.frombuffer(bytes.fromhex(x), ">u4") for x in (heads, tails))


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading samples are equal, by binary search."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[middle - 1] == y[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return low


def likeness(x: tuple, y: tuple) -> float:
    """Of two parsed fingerprints, 0 to 1."""
    if x[:3:2] == y[:3:2]:
        return 1.0
    k = max(x[1], y[1])
    a, b = (slice((1 << k - z[1]) - 1, None, 1 << k - z[1]) for z in (x, y))
    both = sum(_reach(x[i][a], y[i][b]) for i in (3, 4)) << k
    return min(both, x[0], y[0]) / max(x[0], y[0], 1)


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last floor(n/3) code points replaced by the first as many of the next."""
    cut = len(points) // 3
    return np.concatenate([points[: len(points) - cut], following[:cut]])


NAMES = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()


#: Buckets that are ever made: more tasks than a cluster runs, and few enough for
#: one row of each to be broadcast (40 bytes).
MOST_BUCKETS = 50_000


def _beginning(text: Column) -> Column:
    """A text's first seven bytes as a number, in the order of texts."""
    start = F.hex(F.substring(F.substring(text, 1, 7).cast("binary"), 1, 7))
    return F.conv(F.rpad(start, 14, "0"), 16, 10).cast("long")


def bucketed(rows: DataFrame, rows_a_bucket: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text) with ``bucket``, ascending in the order of descending
    doc_id (null last) and then text; and about how many buckets there are.

    Quantiles of doc_id cut the ids into at most 256 stretches, each of which is
    cut evenly by value. An id that fills a stretch alone, and the null ids, are
    cut by how their texts begin instead.
    """
    count, none, low, high = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    size = max(1, rows_a_bucket, -(-count // MOST_BUCKETS))
    parts = -(-count // size)
    bounds: list[int] = []
    if parts > 1 and low is not None:
        quantiles = min(256, parts)
        bounds = rows.agg(F.percentile_approx("doc_id", [i / quantiles for i in range(1, quantiles)], 10_000)).first()[0]
    distinct = sorted(set(bounds))
    stretch = -(-(count - none) // (len(bounds) + 1))
    often = {x: bounds.count(x) for x in distinct if bounds.count(x) > 1}
    fill = lambda n: float(max(1, -(-n // size)))
    # Of 7 bytes, from the first printing character to the last ASCII one.
    start = (_beginning(F.col("text")) - (32 << 48)) / F.lit(float(95 << 48))
    begins = F.least(F.lit(1.0), F.greatest(F.lit(0.0), start))
    key = F.col("doc_id")
    if not distinct:
        inside = F.when(key.isNull(), F.floor(begins * fill(none))).otherwise(0)
        coarse = F.when(key.isNull(), 1).otherwise(0)
        return rows.withColumn("bucket", (F.lit(1 << 32) * coarse + inside).cast("long")), parts
    at = F.size(F.filter(F.array(*[F.lit(x) for x in distinct]), lambda x: x < key))
    ends = F.array(*[F.lit(float(x)) for x in [low - 1, *distinct, max(high, distinct[-1] + 1)]])
    upper, lower = F.get(ends, at + 1), F.get(ends, at)
    even = F.floor((upper - key) / (upper - lower) * fill(stretch))
    hot = F.lit(None).cast("double")
    for x, n in often.items():
        hot = F.when(key == x, F.floor(begins * fill(n * stretch))).otherwise(hot)
    coarse = F.when(key.isNull(), 2 * len(distinct) + 2).otherwise(2 * (len(distinct) - at) + F.when(hot.isNull(), 1).otherwise(0))
    inside = F.when(key.isNull(), F.floor(begins * fill(none))).otherwise(F.coalesce(hot, even))
    return rows.withColumn("bucket", (F.lit(1 << 32) * coarse + inside).cast("long")), parts


def compare(docs: DataFrame, rows_a_bucket: int = 1_000) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next one's.

    "Next" is by descending doc_id, after the last the first; equal doc_ids lie
    in text order, null doc_ids come last. A null text is empty. Repeated rows
    are documents of their own; a document alone is its own next. Other columns
    are ignored; an empty table gives no rows.

    The order is cut into buckets of about ``rows_a_bucket`` rows
    (:func:`bucketed`). One shuffle brings a bucket's rows together,
    and with them the first document of the bucket after it, so a task streams
    through its bucket holding two documents, however long the bucket is. Rows of
    one doc_id whose texts begin alike share a bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed, parts = bucketed(rows, rows_a_bucket)
    # First in order: the largest doc_id, and of its rows those that begin first.
    rank = F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(0)) * F.lit(1 << 56).cast("decimal(17,0)") + _beginning(F.col("text"))
    placed = placed.withColumn("rank", rank.cast("decimal(38,0)"))
    heads = placed.groupBy("bucket").agg(F.min("rank").alias("head"))
    around = Window.orderBy("bucket")  # one row a bucket, at most MOST_BUCKETS and some
    before = F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guards = heads.select("bucket", "head", before.alias("reader"))
    named = placed.join(F.broadcast(guards), "bucket")
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guard"))
    ahead = F.struct(F.col("reader").alias("at"), F.lit(True).alias("guard"))
    reads = F.when(F.col("rank") == F.col("head"), F.array(own, ahead)).otherwise(F.array(own))
    spread = named.select("doc_id", "text", F.explode(reads).alias("r")).select("doc_id", "text", "r.at", "r.guard")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(parts, "at") if parts > tasks else spread.repartition("at")
    ordered = dealt.sortWithinPartitions("at", "guard", F.col("doc_id").desc_nulls_last(), "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x, pa.int64() if i < 2 else pa.string() if i < 5 else pa.float64()) for i, x in enumerate(NAMES)])
        held, done = None, False  # the document before; whether its bucket's guard has come
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in tokens.slices(lengths.tolist(), 2_000_000):
                out: list[tuple] = []
                for key, text, at, guard in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(4)), strict=True):
                    if guard and done:
                        continue  # another row of the guard's doc_id
                    hashed = PrefixHash(text)
                    mark = fingerprint(hashed)
                    parsed = parse(mark)
                    if held and held[0] == at:
                        changed = edited(held[2].points, hashed.points)
                        other = fingerprint(PrefixHash(changed))
                        digest = hashlib.sha256(changed.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
                        out.append((held[1], held[2].n, digest, held[3], other, likeness(held[4], parse(other)), likeness(held[4], parsed)))
                    held, done = (at, key, hashed, mark, parsed), guard
                columns = list(zip(*out, strict=True)) or [()] * len(NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

    return ordered.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
