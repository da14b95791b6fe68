import math
import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from histoloom.llm import shared, simhash
from histoloom.llm.bktree import BKForest, spanning_links


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**12 - 1), unique=True, max_size=80), st.integers(0, 3))
def test_tree_connects_what_brute_force_connects(values, radius):
    every = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius]
    links = spanning_links(values, radius)
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, every)))
    assert roots(len(values), links) == roots(len(values), every)
    tree = BKForest(radius)
    for v in values:
        tree.add(v)
    for v in values[:5]:
        assert sorted(tree.within(v)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= radius]


def mark(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_groups(docs, cases, no_docs):
    marks = [mark(c[1]) for c in cases]
    found = roots(len(cases), [(i, j) for i in range(len(cases)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2])
    least = {}
    for c, r in zip(cases, found, strict=True):
        if c[0] is not None:
            least[r] = min(least.get(r, c[0]), c[0])
    want = Counter((c[0], f"{m:016x}", least.get(r)) for c, m, r in zip(cases, marks, found, strict=True))
    assert Counter(map(tuple, simhash.groups(docs).collect())) == want
    assert simhash.groups(no_docs).count() == 0


def test_links_in_split_shards(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    values = {base}
    while len(values) < 500:
        values.add(r.choice(sorted(values)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    values |= {r.getrandbits(64) for _ in range(200)}
    ordered = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in ordered]
    frame = spark.createDataFrame([(v,) for v in signed], "mark long")
    number = {v: i for i, v in enumerate(signed)}
    every = [(i, j) for i in range(len(ordered)) for j in range(i) if (ordered[i] ^ ordered[j]).bit_count() <= 2]
    for most in (4096, 20):
        links = [(number[x.a], number[x.b]) for x in simhash.links(frame, 2, most).collect()]
        assert roots(len(ordered), links) == roots(len(ordered), every)


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (-(2**63), 3)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for p in pairs for x in p})
    number = {x: i for i, x in enumerate(nodes)}
    found = roots(len(nodes), [(number[a], number[b]) for a, b in pairs])
    got = dict(map(tuple, shared.components(frame).collect()))
    for x, root in zip(nodes, found, strict=True):
        assert got.get(x, x) == nodes[root]


def test_majority_ties_are_zero():
    h = np.array([[0b01], [0b10], [0b11]], np.uint64)
    assert simhash.majority(h, np.array([2, 0, 1])).view("<u8").reshape(-1).tolist() == [0, 0, 3]


def test_dedup_keeps_one_of_a_group(spark, docs, cases, no_docs):
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and 5 not in ids and 7 not in ids
    assert ids[9] == 1 and ids[None] == 1 and ids[16] == 1
    assert sum(ids[i] for i in (11, 12, 13)) == 1
    assert all(ids[100 + i] == 1 for i in range(40))
    assert simhash.dedup(no_docs).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@settings(deadline=None, max_examples=50)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), max_size=14), st.sampled_from([0.3, 0.5, 0.8]))
def test_exact_links(sets, similarity):
    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= similarity]
    links = simhash.exact_links([np.array(sorted(s), np.uint64) for s in sets], similarity)
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in every}
    assert roots(len(sets), links) == roots(len(sets), every)


def test_dedup_is_exact_at_the_threshold(spark):
    r = random.Random(8)
    rows = []
    for g in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        for k in range(4):
            copy = list(words)
            for _ in range(k * 2 + g % 5):
                copy[r.randrange(200)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t, *_ in rows]
    every = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    want = sorted(set(roots(len(rows), every)))
    assert 40 < len(want) < 160
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for most in (2_000, 1):
        assert sorted(x.doc_id for x in simhash.dedup(frame, max_group=most).collect()) == want


def test_dedup_against_similarity(spark):
    r = random.Random(11)
    rows, group = [], {}
    for g in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(300)]
        for k in range(3):
            copy = list(words)
            for _ in range(k * 2):
                copy[r.randrange(300)] = f"x{r.randrange(10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in simhash.dedup(frame).collect()) == [3 * g for g in range(60)]
    # Split shards find them too.
    marked = simhash.wide_fingerprints(frame).withColumnRenamed("doc_id", "node")
    found = shared.components(simhash.wide_links(marked, 92, 1))
    assert {x.node: x.root for x in found.collect()} == {i: 3 * g for i, g in group.items()}


def test_dedup_of_short_texts(spark):
    r = random.Random(21)
    rows = []
    # Words of a text and words added at its end: 4 of 5, 8 of 10, 12 of 15, 40 of 50 and 4 of 6 shingles.
    for n, more in [(8, 1), (12, 2), (16, 3), (44, 10), (8, 2)] * 30:
        words = [f"w{r.randrange(10**6)}" for _ in range(n + more)]
        rows += [(len(rows), " ".join(words[:n]), "en", "s", 1), (len(rows) + 1, " ".join(words), "en", "s", 1)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, *_ in rows)]
    every = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    want = sorted(set(roots(len(rows), every)))
    assert len(want) == 150 + 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in simhash.dedup(frame).collect()) == want


def test_large_groups_are_cut_into_bounded_tasks(spark):
    rows = [(i, " ".join(f"{'x' if k == i % 200 else 'w'}{k}" for k in range(200)), "en", "s", 1) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # One shard of a single common band: no key holds the shard, each two members share one.
    keyed = spark.range(3000).select(F.col("id"), F.explode(simhash.block_pairs(F.lit(7).cast("long"), F.col("id"), F.lit(3000), 500)).alias("key"))
    members = {}
    for r in keyed.collect():
        members.setdefault(r.key, set()).add(r.id)
    assert max(map(len, members.values())) < 700
    assert all(any({a, b} <= m for m in members.values()) for a in range(0, 3000, 97) for b in range(0, a, 89))
    # Members of a large group without a common band are compared too.
    candidates = spark.createDataFrame([(i, 0, [i * 16 + b for b in range(16)]) for i in range(200)], "node long, root long, bands array<long>")
    found = shared.components(simhash.verified(frame, candidates, 5, 0.8, 40))
    assert {x.node: x.root for x in found.collect()} == dict.fromkeys(range(200), 0)


def test_components_of_a_hub(spark):
    star = spark.range(1, 3001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    more = spark.createDataFrame([(7, 40000), (40001, 40000), (50000, 50001)], "a long, b long")
    got = {x.node: x.root for x in shared.components(star.union(more)).collect()}
    assert got == dict.fromkeys([*range(3001), 40000, 40001], 0) | {50000: 50000, 50001: 50000}


def test_radius_is_safe_at_the_threshold():
    # Chance that a bit differs between sets with c shingles in common and a and b more.
    def chance(c, a, b):
        ones = [[sum(math.comb(n, k) for k in range(n + 1) if 2 * (x + k) > c + n) / 2**n for x in range(c + 1)] for n in (a, b)]
        return sum(math.comb(c, x) * (p * (1 - q) + q * (1 - p)) for x, (p, q) in enumerate(zip(*ones, strict=True))) / 2**c

    worst = max(chance(c, a, d - a) for c in range(1, 61) for d in range(c // 4 + 1) for a in range(d // 2 + 1))
    assert worst == chance(4, 0, 1) == 0.1875
    tail = sum(math.comb(512, k) * worst**k * (1 - worst) ** (512 - k) for k in range(simhash.RADIUS + 1, 513))
    assert tail < 1e-11
    # As measured: 4 of 5 shingles, and sets of nothing in common.
    hashes = np.random.default_rng(5).integers(0, 1 << 63, (2000, 5), np.uint64)
    four, five = (simhash.wide_marks(hashes[:, :n].reshape(-1), np.full(2000, n)) for n in (4, 5))
    near = np.unpackbits(four ^ five, axis=1).sum(1)
    assert 94 < near.mean() < 98 and near.max() <= simhash.RADIUS
    assert np.unpackbits(four[1:] ^ five[:-1], axis=1).sum(1).min() > simhash.RADIUS


def test_tree_finds_what_is_confirmed(monkeypatch):
    r = random.Random(41)
    sets = []
    for _ in range(30):
        base = [r.getrandbits(63) for _ in range(r.choice([4, 9, 40, 200]))]
        sets += [np.unique(np.array(base[: len(base) - n] + [r.getrandbits(63) for _ in range(n)], np.uint64)) for n in (0, 0, len(base) // 12, len(base) // 3)]
    seen = []
    similar = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda a, b, s: seen.append((a, b)) or similar(a, b, s))
    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    links = simhash.exact_links(sets, 0.8, radius=simhash.RADIUS)
    assert roots(len(sets), links) == roots(len(sets), every)
    # Sets of other texts are beyond the radius, and are not confirmed one by one.
    assert len(every) // 2 <= len(seen) < 10 * len(sets)
    # Only what the tree finds is linked; components that are known are not searched.
    assert all(np.array_equal(sets[i], sets[j]) for i, j in simhash.exact_links(sets, 0.8, radius=0))
    seen.clear()
    assert simhash.exact_links(sets, 0.8, [5] * len(sets)) == [] == seen
    known = [i % 7 for i in range(len(sets))]
    joined = [(i, j) for i in range(len(sets)) for j in range(i) if known[i] == known[j]]
    assert roots(len(sets), simhash.exact_links(sets, 0.8, known, radius=simhash.RADIUS) + joined) == roots(len(sets), every + joined)


def test_dedup_searches_fingerprints(spark):
    r = random.Random(43)
    rows = []
    for _ in range(20):
        words = [f"w{r.randrange(5000)}" for _ in range(100)]
        rows += [(len(rows) + k, " ".join(x), "en", "s", 1) for k, x in enumerate([words, words, [*words, "more"], [*words[:40], *"abcdefghij", *words[40:]]])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for most in (2_000, 1):
        assert sorted(x.doc_id for x in simhash.dedup(frame, max_group=most).collect()) == list(range(0, 80, 4))
        # The tree of radius 0 finds equal fingerprints only, whatever shares a band.
        assert sorted(x.doc_id for x in simhash.dedup(frame, max_group=most, radius=0).collect()) == [i for i in range(80) if i % 4 != 1]
