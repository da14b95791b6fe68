"""Operators that SQL cannot express, against plain versions of the same."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from histoloom.llm import media, packing, prefixhash, quality, queries, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# Quality: expectation-maximisation and training, a document at a time.


def plain_model(votes):
    good = [0.05 if "b" in v else 0.95 for v in votes]
    last = None
    for _ in range(200):
        prior = (sum(good) + 1) / (len(votes) + 2)
        tables = []
        for i in range(9):
            both = []
            for of in (lambda g: 1 - g, lambda g: g):
                n = {v: 1.0 + sum(of(g) for g, p in zip(good, votes, strict=True) if p[i] == v) for v in "bg-"}
                both.append({v: n[v] / sum(n.values()) for v in n})
            tables.append(both)
        good = []
        for p in votes:
            bad, fine = 1 - prior, prior
            for i, v in enumerate(p):
                bad, fine = bad * tables[i][0][v], fine * tables[i][1][v]
            good.append(fine / (bad + fine))
        flat = [x for both in tables for t in both for x in t.values()]
        if last and max(abs(a - b) for a, b in zip(flat, last, strict=True)) < 1e-7:
            break
        last = flat
    return good


def shape(word):
    if word.isalpha() and word.islower() and len(word) > 1:
        return "aa"
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1\1+", r"\1\1", kinds, flags=re.DOTALL)


def plain_features(text):
    words = (text or "").split()
    if not words:
        return Counter([0])
    s = [zlib.crc32(shape(w).encode()) & 0x7FFFFFFF for w in words]
    keys = [x * 3 for x in s] + [(x * 1_000_003 + y) * 3 + 1 for x, y in zip(s, s[1:])] + [(a == b) * 3 + 2 for a, b in zip(words, words[1:])]

    def bucket(k):
        k = k * 0x5851F42D4C957F2D & (1 << 64) - 1
        return ((k - (1 << 64) if k >> 63 else k) >> 33) % (quality.BUCKETS - 1) + 1

    return Counter(map(bucket, keys))


def plain_scorer(features, labels):
    x = np.zeros((len(features), quality.BUCKETS))
    for row, f in zip(x, features, strict=True):
        for k, n in f.items():
            row[k] = n / sum(f.values())
    w, b, past, past_b = np.zeros(quality.BUCKETS), 0.0, np.full(quality.BUCKETS, 1e-8), 1e-8
    for _ in range(300):
        off = (1 / (1 + np.exp(-(x @ w + b))) - labels) / len(labels)
        slope = off @ x + 1e-5 * w
        past, past_b = past + slope**2, past_b + off.sum() ** 2
        w, b = w - slope / np.sqrt(past), b - 0.1 * off.sum() / math.sqrt(past_b)
    return w, b


def test_quality_by_hand(spark, docs, cases):
    junk = [(1000 + i, ("BUY!! NOW!! " * 60 if i % 2 else "word " * 90), "en", "a", 1, "", "", "") for i in range(12)]
    more = docs.union(spark.createDataFrame(junk, docs.schema))
    texts = [c[1] for c in [*cases, *junk]]
    posterior = plain_model([quality.votes(t) for t in texts])
    features = [plain_features(t) for t in texts]
    w, b = plain_scorer(features, np.array(posterior))
    want = Counter()
    for c, p, f in zip([*cases, *junk], posterior, features, strict=True):
        z = sum(w[k] * n for k, n in f.items()) / sum(f.values()) + b
        want[c[0], round(p, 4), round(1 / (1 + math.exp(-z)), 4)] += 1
    got = Counter((r.doc_id, round(r.posterior, 4), round(r.score, 4)) for r in quality.classify(more).collect())
    assert got == want


def test_quality_sample_is_repeatable(spark):
    r = random.Random(6)
    rows = [(None if i % 2 else 7, " ".join(r.choice(["ab", "AB!", "c9", "."]) for _ in range(30)), "en", "s", 1) for i in range(300)]
    rows += [(7, "same text here.", "en", "s", 1)] * 100
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(sorted((x.votes, round(x.score, 9)) for x in quality.classify(frame.repartition(n), sample=20).collect())) for n in (1, 3, 7)}
    assert len(found) == 1


# Toxicity: clauses read by rules, lexicon and curve counted by hand.


def plain_clause(symbols):
    matters = [i for i, x in enumerate(symbols) if x in (toxicity.INSULT, toxicity.THREAT)]
    if not matters:
        return 0.0
    insult, aimed = toxicity.INSULT in symbols, toxicity.TARGET in symbols
    weight = (1.0 if insult else 0.4) + ((0.5 if insult else 0.6) if aimed else 0.0)
    if all(toxicity.NEGATION in symbols[max(0, i - 4) : i] for i in matters):
        weight *= 0.3
    if toxicity.REPORT in symbols[: matters[0]]:
        weight *= 0.6
    return weight


def plain_evidence(text, words, stems):
    total = 0.0
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        symbols, heaviest = [], 0.0
        for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause):
            weight = max([words.get(w, 0.0), *(stems.get(w[:n], 0.0) for n in (4, 5, 6) if len(w) >= n)])
            kind = toxicity.TARGET if w in toxicity.TARGETS else toxicity.NEGATION if w in toxicity.NEGATIONS else toxicity.REPORT if w in toxicity.REPORTS else toxicity.OTHER
            symbols.append(kind if weight <= 0 else toxicity.THREAT if w in toxicity.THREATS else toxicity.INSULT)
            heaviest = max(heaviest, weight)
        total += plain_clause(symbols) * heaviest
    return total


def plain_toxicity(rows, labels):
    """Scores of all rows; labels: doc_id to 0 or 1."""
    kept = {}
    for i, text in rows:
        if i in labels and zlib.crc32(str(i).encode()) % 4 != 2:
            words = text.lower().encode().split()
            least = min((xxhash.xxh64_intdigest(b" ".join(words[k : k + 5]), 42) for k in range(max(1, len(words) - 4))), default=0) >> 1
            kept[least, labels[i]] = min(text, kept.get((least, labels[i]), text))
    has = defaultdict(list)
    for (_, y), text in kept.items():
        found = {w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text.lower()) if len(w) > 2}
        has[y].append(found | {w[:n] + "*" for w in found for n in (4, 5, 6) if len(w) >= n})
    toxic, fine = len(has[1]), len(has[0])
    n, against = (Counter(f for x in has[y] for f in x) for y in (1, 0))
    bar, own = max(4, toxic // 100), {*toxicity.INSULTS, *toxicity.THREATS}

    def weight(f):
        before = 3.0 if f in own else 0.0
        return math.log((n[f] + before + 0.5) / (toxic + before + 1)) - math.log((against[f] + 0.5) / (fine + before + 1))

    told = [f for f in n if n[f] >= bar and against[f] <= 0.05 * n[f]]
    stems = {f[:-1]: weight(f) for f in told if f[-1] == "*"}
    stems = {f: w for f, w in stems.items() if not any(f[:k] in stems for k in (4, 5) if k < len(f))}
    words = {f: weight(f) for f in told if f[-1] != "*"} | {f: max(0.0, weight(f)) for f in own}
    x = np.array([math.log1p(plain_evidence(t, words, stems)) for t in kept.values()])
    y = np.array([k[1] for k in kept], float)
    a, b = 2.0, -3.0
    for _ in range(200):  # gradient and curvature of the penalised likelihood
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((p - y) * x).sum() + a - 2.0, (p - y).sum() + b + 3.0])
        c = p * (1 - p)
        h = np.array([[(c * x * x).sum() + 1, (c * x).sum()], [(c * x).sum(), c.sum() + 1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return {i: 1 / (1 + math.exp(-(max(0.05, a) * math.log1p(plain_evidence(t, words, stems)) + b))) for i, t in rows}


def toxic_corpus():
    r = random.Random(12)
    plain = ["".join(r.choice("aeio") + r.choice("bdgkl") for _ in range(3)) for _ in range(200)] + ["you", "not", "said", "they", "."]
    rows, labels = [], {}
    for i in range(400):
        text = [r.choice(plain) for _ in range(40)]
        labels[i] = int(r.random() < 0.25)
        for _ in range(3 * labels[i]):
            text[r.randrange(40)] = r.choice(["idiot", "kill", "vrakal" + r.choice(["o", "um", "is"]), "moron"])
        rows.append((i, " ".join(text)))
    return rows, labels


def test_toxicity_by_hand(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], SCHEMA)
    table = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    want = plain_toxicity(rows, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, table).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_clauses_by_rule():
    r = random.Random(3)
    for _ in range(3000):
        symbols = [r.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(r.randrange(12))]
        assert toxicity.WEIGHTS[toxicity.GRAMMAR.run(symbols)] == pytest.approx(plain_clause(symbols))


# Packing: every piece of every document.


def test_every_piece(docs, cases):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for c in cases:
        ids = np.array([*tokenizer.encode(c[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[c[0], ids.tobytes()] += 1
    rows = packing.pack(docs, tokens.default_path(), 1, 128).collect()
    whole = {(k[0], len(k[1]) // 4, zlib.crc32(k[1])): k for k in want}
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id, r.doc_tokens].append(r)
    for (doc_id, n), pieces in by_id.items():
        bodies = [np.frombuffer(k[1], "<u4") for k in whole.values() if k[0] == doc_id and len(k[1]) == 4 * n]
        copies = sum(want[k] for k in whole.values() if k[0] == doc_id and len(k[1]) == 4 * n)
        covered = Counter()
        for p in pieces:
            assert p.ids_crc32 in {zlib.crc32(b[p.start : p.start + p.length].tobytes()) for b in bodies}
            covered.update(range(p.start, p.start + p.length))
        assert covered == Counter(dict.fromkeys(range(n), copies))


# Media: the cosine transform written out.


def test_cosine_hash_by_hand():
    r = random.Random(2)
    for n in (1, 40, 900):
        pixels, _ = media.text_pixels(" ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(n)))
        height, width = pixels.shape
        cell = [[0.0] * 32 for _ in range(32)]
        for i in range(32):
            for j in range(32):
                top, left = i * height // 32, j * width // 32
                block = pixels[top : max(top + 1, (i + 1) * height // 32), left : max(left + 1, (j + 1) * width // 32)]
                cell[i][j] = sum(map(int, block.reshape(-1))) / block.size
        found = [round(sum(cell[i][j] * math.cos(math.pi / 32 * (i + 0.5) * u) * math.cos(math.pi / 32 * (j + 0.5) * v) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
        middle = sorted(found[1:])[31]
        bits = "".join("01"[k > 0 and x > middle] for k, x in enumerate(found))
        assert media.cosine_hash(pixels) == f"{int(bits, 2):016x}"


def test_filters_are_used_where_they_help(spark):
    pixels, _ = media.text_pixels("Some text. " * 40)
    kinds = media.flat_kinds(pixels)
    assert set(kinds.tolist()) >= {0, 1}
    stored = media.encode(pixels, kinds=kinds)
    assert (media.decode(stored) == pixels).all()


# Prefix hashes: hot and null ids in many buckets.


def test_hot_ids_are_split(spark):
    r = random.Random(9)
    rows = [(i if i % 3 else None if i % 2 else 77, "".join(r.choice("abcxyz ") for _ in range(r.randrange(30))), "en", "s", 1) for i in range(600)]
    rows += [(77, "twice", "en", "s", 1)] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    placed, _ = prefixhash.bucketed(frame.select("doc_id", "text"), 10)
    order = lambda x: (x.doc_id is None, -(x.doc_id or 0), x.text.encode())
    listed = sorted(placed.collect(), key=order)
    assert [x.bucket for x in listed] == sorted(x.bucket for x in listed)
    assert max(Counter(x.bucket for x in listed).values()) < 60
    got = Counter((x.doc_id, x.near_next) for x in prefixhash.compare(frame, 10).collect())
    marks = [prefixhash.parse(prefixhash.fingerprint(prefixhash.PrefixHash(x.text))) for x in listed]
    want = Counter((x.doc_id, prefixhash.likeness(marks[i], marks[(i + 1) % len(marks)])) for i, x in enumerate(listed))
    assert got == want


# The pipeline, stage by stage.


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_pipeline_by_hand(spark, tmp_path):
    rows, labels = toxic_corpus()
    r = random.Random(5)
    rows = [(i, t.capitalize() + ".") for i, t in rows]
    rows += [(500 + i, rows[i][1]) for i in range(0, 90, 3)]
    rows += [(600 + i, rows[i][1].replace(" ", " odd ", 1)) for i in range(0, 90, 5)]
    rows += [(700 + i, "WIN $$$ NOW!! " * r.randrange(20, 40)) for i in range(20)]
    full = [(i, t, "en", f"s{i % 3}", 1) for i, t in rows]
    folder = str(tmp_path)
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = queries.table(spark, folder, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        seen.append(docs.collect())
    text = dict(rows)
    score = plain_toxicity(rows, labels)
    left = [i for i, _ in rows if score[i] < 0.3]
    assert sorted(x.doc_id for x in seen[0]) == sorted(left)
    posterior = plain_model([quality.votes(text[i]) for i in left])
    features = [plain_features(text[i]) for i in left]
    w, b = plain_scorer(features, np.array(posterior))
    left = [i for i, f in zip(left, features, strict=True) if sum(w[k] * n for k, n in f.items()) / sum(f.values()) + b >= 0]
    assert sorted(x.doc_id for x in seen[1]) == sorted(left)
    sets = {i: shingles(text[i]) for i in left}
    group = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    left = sorted(set(group.values()))
    assert sorted(x.doc_id for x in seen[2]) == left
    # Copies: each 0 to 2 times, sources near their targets.
    size = {i: len(text[i].split()) for i in left}
    taken, total = Counter(), Counter()
    copies = Counter(x.doc_id for x in seen[3])
    for i in left:
        total[i % 3] += size[i]
        taken[i % 3] += size[i] * copies[i]
    target, rest = {}, 1.5 * sum(total.values())
    order = sorted(total, key=lambda s: 2 * total[s] / (3, 1, 2)[s])
    for k, s in enumerate(order):
        target[s] = min(2 * total[s], rest * (3, 1, 2)[s] / sum((3, 1, 2)[x] for x in order[k:]))
        rest -= target[s]
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= min(size.values()) for s in total)
    pieces = Counter()
    for x in seen[4]:
        pieces[x.doc_id] += x.length
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    assert pieces == Counter({i: n * (len(tokenizer.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in copies.items()})


def test_large_group_in_bounded_tasks(spark):
    r = random.Random(31)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(900):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = sorted({find(i) for i in range(len(rows))})
    frame = spark.createDataFrame(rows, SCHEMA)
    assert 1 < len(want) < 600
    assert sorted(x.doc_id for x in simhash.dedup(frame, max_group=60).collect()) == want
    # Each two members of different components meet, and no task holds the group.
    from pyspark.sql import functions as F

    members = spark.createDataFrame([(i, 0 if i % 10 else i) for i in range(2000)], "node long, known long")
    keys = simhash.open_pairs(F.col("node"), F.col("known"), F.lit(0).cast("long"), F.lit(1800), F.lit(200), 200)
    held = defaultdict(set)
    for x in members.select("node", F.explode(keys).alias("key")).collect():
        held[x.key].add(x.node)
    assert max(map(len, held.values())) < 300
    assert all(any({a, b} <= h for h in held.values()) for a in range(70, 2000, 70) for b in range(1, 2000, 61) if a != b)
    assert sum(map(len, held.values())) < 2000 * 12
