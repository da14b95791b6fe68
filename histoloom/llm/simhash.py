"""SimHash fingerprints and near-duplicate groups by BK-trees.

Fingerprints within a radius are linked; groups are the connected components.
A tree of the whole corpus would grow with it and would have to be sent to
every task, and what a query visits of it grows too (0.6 % of 50,000 random
64-bit values at radius 2). So the corpus is cut into *shards* such that every link lies within some
shard, and each shard's tree is built by the task that holds the shard:

* 64-bit fingerprints, radius 2: the bits are cut into four blocks of 16; two
  fingerprints within 2 bits agree on at least two blocks. A shard is a choice
  of two blocks and their values. Shards of more than ``max_shard``
  fingerprints are cut once more, by two of the four bytes that are left, and
  then hold at most 65,536 fingerprints, since fingerprints are distinct.
* wide fingerprints, similarity 0.8: the radius is too large for blocks (the
  expected distance is 15 % of the bits), so shards are made of bands of minimal
  shingle hashes, of which texts of Jaccard similarity 0.8 share one of 16
  with probability 0.9998: a shard is all that is connected by common bands.
  Bands only say where a tree is built. What is held against what is found in
  the tree, within a radius that is safe for short texts too (:data:`RADIUS`),
  and only what the tree finds is confirmed by exact similarity and linked.

Equal fingerprints are merged by a pre-aggregated ``groupBy`` before anything
else, so groups of exact copies of any size cost nothing further on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histoloom.llm import memos, shared, tokens
from histoloom.llm.bktree import BKForest, spanning_links

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 (seed 42) of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [digest(joined, 42)] if words else []
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[size - 1 :])]  # noqa: B905


def majority(hashes: np.ndarray, counts: np.ndarray, bits: int = 64) -> np.ndarray:
    """Bits that over half of each text's hashes have set: uint8 of (texts, bits/8).

    ``hashes``: uint64 of (all shingles, bits/64), texts one after another.
    """
    out = np.zeros((len(counts), bits // 8), np.uint8)
    some = np.flatnonzero(counts)
    if len(some):
        flat = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
        ends = np.cumsum(counts)[some]
        ones = np.zeros((len(some), bits), np.int32)
        for row, a, b in zip(ones, (ends - counts[some]).tolist(), ends.tolist(), strict=True):
            for i in range(a, b, 255):  # whose sums fit a byte
                row += np.add.reduce(flat[i : min(i + 255, b)], axis=0, dtype=np.uint8)
        out[some] = np.packbits(ones * 2 > counts[some, None], axis=1, bitorder="little")
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and 64-bit fingerprint (long, its bits as they are) of every row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.only()
        for batch in batches:
            body = batch.column(1)
            lengths = np.nan_to_num(pa.compute.binary_length(body).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in tokens.slices(lengths.tolist(), 2_000_000):
                hashes = [shingle_hashes(x, shingle) for x in body.slice(a, b - a).to_pylist()]
                counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
                flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum())).reshape(-1, 1)
                marks = majority(flat, counts).view("<i8").reshape(-1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(marks)], names=["doc_id", "mark"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(marked, "doc_id long, mark long")


def _pairs(value: Column, width: int) -> Column:
    """Keys of ``value`` (4 x width bits): each choice of two of four blocks."""
    block = [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]
    return F.array(*[F.lit(n << 2 * width).bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j]) for n, (i, j) in enumerate(combinations(range(4), 2))])


def _left_over(value: Column, key: Column) -> Column:
    """The two 16-bit blocks that a key of :func:`_pairs` leaves out."""
    block = [F.shiftrightunsigned(value, i * 16).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    out = F.lit(None).cast("long")
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = sorted({0, 1, 2, 3} - {i, j})
        out = F.when(F.shiftrightunsigned(key, 32) == n, F.shiftleft(block[k], 16).bitwiseOR(block[m])).otherwise(out)
    return out


def links(marks: DataFrame, radius: int = 2, max_shard: int = 4096) -> DataFrame:
    """Links between distinct 64-bit fingerprints of column ``mark``: a, b.

    Enough of the pairs within ``radius`` (at most 2) to connect all that they
    connect; every one of them is such a pair.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree for certain only within 2 bits")
    keyed = marks.select("mark", F.explode(_pairs(F.col("mark"), 16)).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > max_shard).select("key", F.lit(True).alias("hot"))
    sub = F.when(F.col("hot"), _pairs(_left_over(F.col("mark"), F.col("key")), 8)).otherwise(F.array(F.lit(-1).cast("long")))
    cut = keyed.join(hot, "key", "left").select("mark", "key", F.explode(sub).alias("sub"))
    shards = cut.groupBy("key", "sub").agg(F.collect_list("mark").alias("marks")).where(F.size("marks") > 1).select("marks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.only()
        for batch in batches:
            ends: tuple[list, list] = [], []
            for values in batch.column(0).to_pylist():
                for i, j in spanning_links([v & 0xFFFFFFFFFFFFFFFF for v in values], radius):
                    ends[0].append(values[i])
                    ends[1].append(values[j])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    return shards.mapInArrow(searched, "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, max_shard: int = 4096) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included. Null and empty texts have fingerprint zero and are linked like any
    other; a null doc_id gives its row no id but its fingerprint takes part;
    repeated rows come as often as they are there; other columns are ignored; an
    empty table gives no rows.
    """
    marked = shared.written(fingerprints(docs, shingle), "marks")
    distinct = shared.written(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "distinct")
    roots = shared.components(links(distinct, radius, max_shard)).toDF("mark", "root")
    rooted = distinct.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("mark", "root").join(least, "root").select("mark", "component_id")
    fingerprint = F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint")
    return marked.join(named, "mark").select("doc_id", fingerprint, "component_id")


# Wide fingerprints, for a similarity of 0.8.

WORDS, BANDS, ROWS = 8, 16, 4
#: Of 512 bits. Texts of similarity 0.8 or more differ in 19 % of them at most on
#: average (4 of 5 shingles), and in more than 160 with probability 4e-12.
RADIUS = 160
_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 1 << 63, (2, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 1 << 31, (BANDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def wide_marks(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """512-bit fingerprints (uint8) of each text.

    ``hashes``: distinct shingle hashes of each text, texts one after another.
    """
    mixed = hashes[:, None] * _ODD[0]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[1]
    mixed ^= mixed >> np.uint64(32)
    return majority(mixed, counts, 64 * WORDS)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 band keys (int64) of each text, for the same hashes: what shards its
    fingerprint may lie in."""
    keys = np.zeros((len(counts), BANDS), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        for i, (a, b) in enumerate(_MUL):
            least = np.minimum.reduceat(low * np.uint32(a) + np.uint32(b & np.uint64(0xFFFFFFFF)), starts)
            key = keys[some, i // ROWS]
            keys[some, i // ROWS] = (key ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i // ROWS)
    return keys.view(np.int64)


def _hashed(body: pa.Array, shingle: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, int, int]]:
    """Distinct shingle hashes of each text, their numbers, and where the texts
    begin and end, a slice of texts at a time."""
    lengths = np.nan_to_num(pa.compute.binary_length(body).to_numpy(zero_copy_only=False)).astype(np.int64)
    for a, b in tokens.slices(lengths.tolist(), 100_000):
        hashes = [np.unique(np.array(shingle_hashes(x, shingle), np.uint64)) for x in body.slice(a, b - a).to_pylist()]
        yield hashes, np.fromiter(map(len, hashes), np.int64, len(hashes)), a, b


def wide_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, wide fingerprint (binary) and band keys of every row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.only()
        for batch in batches:
            for hashes, counts, a, b in _hashed(batch.column(1), shingle):
                flat = np.concatenate(hashes)
                marks, keys = wide_marks(flat, counts), band_keys(flat, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in marks], pa.binary()), lists], names=["doc_id", "mark", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(marked, "doc_id long, mark binary, bands array<long>")


def block_pairs(key: Column, node: Column, count: Column, most: int) -> Column:
    """Keys of the tasks that a member of a group of ``count`` goes to.

    Members are dealt to blocks of about ``most`` / 2, and each pair of blocks is
    a task of about ``most`` members; so each two members meet in some task. The
    copies of a member grow with the number of blocks.
    """
    blocks = F.greatest(F.lit(2), F.ceil(count / F.lit(max(1, most // 2)))).cast("long")
    # Salted, so that the block does not hang on the partition of a node.
    own = F.pmod(F.xxhash64(node, F.lit(17)), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: i != own)
    return F.transform(others, lambda i: F.xxhash64(key, F.least(own, i), F.greatest(own, i)))


def wide_links(nodes: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """Links between ``node``s whose fingerprints are within ``radius``: a, b.

    Shards of more than ``max_shard`` members are cut into blocks that are held
    against each other in pairs (:func:`block_pairs`).
    """
    alone = nodes.select("node", "mark", F.explode("bands").alias("key"))
    # Written, so that its size is known before the joins with it are planned.
    hot = shared.written(alone.groupBy("key").count().where(F.col("count") > max_shard), "hot")
    cool = alone.join(hot, "key", "left_anti").select("node", "mark", "key")
    cut = alone.join(hot, "key").select("node", "mark", F.explode(block_pairs(F.col("key"), F.col("node"), F.col("count"), max_shard)).alias("key"))
    rows = cool.union(cut).repartition("key").sortWithinPartitions("key")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.only()
        last, names, values = None, [], []
        ends: tuple[list, list] = [], []

        def search() -> None:
            if len(names) > 1:
                for i, j in spanning_links(values, radius):
                    ends[0].append(names[i])
                    ends[1].append(names[j])

        for batch in batches:
            for node, mark, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != last:
                    search()
                    last, names, values = key, [], []
                names.append(node)
                values.append(int.from_bytes(mark, "little"))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])
            ends = [], []
        search()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    return rows.mapInArrow(searched, "a long, b long")


def band_mates(nodes: DataFrame) -> DataFrame:
    """Links that connect all ``node``s that share a band: a, b.

    Each member of a band is linked to its smallest, whatever the distance.
    """
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("key", "b")
    return keyed.join(least, "key").where("node <> b").select(F.col("node").alias("a"), "b")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have that Jaccard similarity or more."""
    low, high = sorted((len(a), len(b)))
    if low < similarity * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (low + high - both)


def exact_links(sets: list[np.ndarray], similarity: float, known: list[int] | None = None, marks: list[int] | None = None, radius: int = 64 * WORDS) -> list[tuple[int, int]]:
    """Index pairs of Jaccard similarity or more that, with the components
    already ``known`` (a name for each set), connect all that such pairs
    connect.

    Pairs are found by a BK-tree of the sets' wide fingerprints (``marks``, made
    here if not given): those within ``radius`` that are not yet connected are
    confirmed by :func:`similar`. The default radius takes in every pair.
    """
    if marks is None:
        counts = np.fromiter(map(len, sets), np.int64, len(sets))
        marks = _numbers(wide_marks(np.concatenate([np.zeros(0, np.uint64), *sets]), counts))
    tree, first = BKForest(radius), {}
    links = []
    for i, (own, mark) in enumerate(zip(sets, marks, strict=True)):
        beside = first.setdefault(known[i], i) if known else i
        links += [(j, i) for j in tree.add(mark, lambda j, own=own: similar(own, sets[j], similarity), None if beside == i else beside)]
    return links


def _numbers(marks: np.ndarray) -> list[int]:
    return [int.from_bytes(x.tobytes(), "little") for x in marks]


def _sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """node, root, the shingle set and its wide fingerprint of each member (node, root)."""
    # Rows are shuffled at every size, as in dedup.
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(members.hint("shuffle_merge"), "node")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.only()
        for batch in batches:
            for hashes, counts, a, b in _hashed(batch.column(2), shingle):
                marks = wide_marks(np.concatenate(hashes), counts)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (hashes, marks))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "body", "mark"])

    return texts.select("node", "root", "text").mapInArrow(shingled, "node long, root long, body binary, mark binary")


def _linked(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links a, b within each ``key`` of rows (key, node, known, body, mark),
    by one BK-tree a key."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, known, sets, marks = None, [], [], [], []
        ends: tuple[list, list] = [], []

        def link() -> None:
            for i, j in exact_links(sets, similarity, known, marks, radius):
                ends[0].append(names[i])
                ends[1].append(names[j])

        for batch in batches:
            for key, node, in_, body, mark in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != last:
                    link()
                    last, names, known, sets, marks = key, [], [], [], []
                names.append(node)
                known.append(in_)
                sets.append(np.frombuffer(body, np.uint64))
                marks.append(int.from_bytes(mark, "little"))
        link()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    return rows.select("key", "node", "known", "body", "mark").repartition("key").sortWithinPartitions("key", "known", "node").mapInArrow(linked, "a long, b long")


def open_pairs(node: Column, known: Column, largest: Column, inside: Column, outside: Column, most: int) -> Column:
    """Keys of the tasks of a member of a group whose largest component holds
    ``inside`` members and whose others hold ``outside``.

    Members are dealt to blocks of about ``most`` / 2, those of the largest
    component apart. A task is two blocks, at least one of them of the others,
    so each two members of different components meet in some task, and members
    of the largest are copied as often as the *others* have blocks.
    """
    half = F.lit(max(1, most // 2))
    inner, outer = (F.greatest(F.lit(1), F.ceil(n / half)).cast("long") for n in (inside, outside))
    own = F.when(known == largest, F.pmod(F.xxhash64(node, F.lit(17)), inner)).otherwise(inner + F.pmod(F.xxhash64(node, F.lit(19)), outer))
    others = F.sequence(F.when(known == largest, inner).otherwise(F.lit(0).cast("long")), inner + outer - 1)
    return F.transform(others, lambda i: F.xxhash64(largest, F.least(own, i), F.greatest(own, i)))


def verified(docs: DataFrame, candidates: DataFrame, shingle: int, similarity: float, max_group: int, deals: int = 2, radius: int = RADIUS) -> DataFrame:
    """Links of candidates (node, root): a, b. They are pairs within ``radius``
    that the BK-tree of their shard (``root``) finds, confirmed by the exact
    Jaccard similarity of their shingle sets.

    A shard is one task's tree unless it has more than ``max_group``
    members. Then it is dealt to tasks of about half as many, each task links
    its own, and it is dealt once more, which joins nearly all that belongs
    together: members are copied once a deal, so a group of near copies costs
    in proportion to its size. What is then not in the largest component is held
    against all members of other components (:func:`open_pairs`), so at every
    size all pairs are compared or known to be connected.
    """
    counts = candidates.groupBy("root").agg(F.count("*").alias("count"))
    # Written, so that its size is known before the joins with it are planned.
    large = shared.written(counts.where(F.col("count") > max_group), "large")
    members = candidates.select("node", "root")
    single = _sets(docs, members.join(large, "root", "left_anti").select("node", "root"), shingle)
    links = _linked(single.select(F.col("root").alias("key"), "node", F.col("node").alias("known"), "body", "mark"), similarity, radius)
    if large.isEmpty():
        return links
    links = shared.written(links, "links")
    sets = shared.written(_sets(docs, members.join(large, "root").select("node", "root"), shingle), "sets").join(large, "root")
    found, rooted = None, sets.withColumn("known", F.col("node"))

    def with_known(of: DataFrame) -> DataFrame:
        held = shared.components(of).toDF("node", "known")
        return sets.join(held, "node", "left").withColumn("known", F.coalesce("known", "node"))

    for i in range(deals):
        blocks = F.ceil(F.col("count") / F.lit(max(1, max_group // 2))).cast("long")
        dealt = rooted.withColumn("key", F.xxhash64("root", F.lit(i), F.pmod(F.xxhash64("node", F.lit(i)), blocks)))
        got = shared.written(_linked(dealt, similarity, radius), "links")
        found = got if found is None else found.union(got)
        rooted = with_known(found)
    sizes = shared.written(rooted.groupBy("root", "known").agg(F.count("*").alias("n")), "sizes")
    open_ = sizes.groupBy("root").agg(F.max(F.struct("n", "known")).alias("top"), F.sum("n").alias("all")).where(F.col("top.n") < F.col("all"))
    left = rooted.join(open_, "root")
    keys = open_pairs(F.col("node"), F.col("known"), F.col("top.known"), F.col("top.n"), F.col("all") - F.col("top.n"), max_group)
    last = _linked(left.withColumn("key", F.explode(keys)), similarity, radius)
    return links.union(found).union(last)


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_group: int = 2_000, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each group.

    Groups are the components of links between texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more. Texts that are connected
    by common bands are a shard; the BK-tree of a shard finds the pairs of wide
    fingerprints within ``radius``, and these are confirmed by their exact
    similarity. What can be missed are pairs without a common band, 0.02 % of
    those at exactly 0.8 and fewer above, and those beyond the radius, 4 in
    10¹² at most. That holds for similarity 0.8: a lower one needs a larger radius.

    Rows that share a doc_id count as one document: they stay or go together,
    and of those that stay the one whose text comes first is left. Rows with a
    null doc_id cannot be named and stay. Null and empty texts are equal texts. All columns
    come back as they were; an empty table gives no rows.
    """
    marked = shared.written(wide_fingerprints(docs, shingle), "wide")
    nodes = shared.written(marked.where("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")
    near = shared.components(band_mates(nodes)).toDF("node", "root")
    candidates = shared.written(near, "candidates")
    roots = shared.components(verified(docs, candidates, shingle, similarity, max_group, radius=radius)).toDF("node", "root")
    rooted = nodes.select("mark", "node").join(roots, "node", "left").select("mark", F.coalesce("root", "node").alias("root"))
    named = shared.written(marked.select("doc_id", "mark").where("doc_id is not null").join(rooted, "mark").select("doc_id", "root"), "named")
    # Both grow with the corpus, so whole rows are shuffled, once, at every size.
    kept = docs.join(named.where("doc_id <> root").select("doc_id").distinct().hint("shuffle_merge"), "doc_id", "left_anti")
    repeated = named.where("doc_id = root").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    # Of a repeated doc_id the row whose text, then whose columns come first.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    some = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("row"))
    return kept.join(repeated.select("doc_id"), "doc_id", "left_anti").select(docs.columns).union(some.select("row.*"))
