import random
import zlib
from collections import Counter

import numpy as np
import pytest

from histoloom.llm import quality, toxicity


def test_grammar_composes():
    g = toxicity.GRAMMAR
    one = lambda text: toxicity.Model({"idiot": 2.0, "kill": 1.0}, {"chlla": 3.0}, 1.0, -2.0).evidence(text)
    assert len(g.states) == len(set(g.states)) and all(len(row) == 6 for row in g.table)
    plain, aimed = one("what an idiot"), one("you are an idiot")
    denied, quoted = one("that thing is not an idiot"), one("he said idiot")
    assert plain == 2.0 and aimed == 3.0
    assert denied < plain and quoted < aimed
    assert one("you idiot. you idiot") == 2 * one("you idiot")
    assert one("I will kill you") > one("kill the lights")
    assert one("CHLLAZA!!") == 3.0 and one("challa") == 0.0
    assert one("") == one(None) == 0.0


def corpus(n=600, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("aeio") + r.choice("bdgkl") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(40)]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(3):
                text[r.randrange(40)] = r.choice(["idiot", "moron", "vrakal" + r.choice(["o", "um", "is"])])
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, table).collect()}
    truth = {x[0]: x[2] for x in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    wrong = [i for i, r in got.items() if r.held_out and r.predicted != truth[i]]
    assert len(wrong) <= 2
    # Labels of held-out rows do not matter.
    turned = spark.createDataFrame([(i, q, 1 - t if got[i].held_out else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_edges(spark, docs, cases, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(c[0] for c in cases)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(no_docs, none).count() == 0
    bare = spark.createDataFrame([(1, "you stupid idiot, you moron"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(bare, none).collect()} == {1: 1, 2: 0, 3: 0}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(cases)


def test_estimation_recovers_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.8
    counts: Counter = Counter()
    for good in truth:
        votes = ["b" if (not good and r.random() < 0.5) or (good and r.random() < 0.01) else "-" for _ in range(5)]
        votes += ["g" if r.random() < (0.9 if good else 0.3) else "-" for _ in range(4)]
        counts["".join(votes)] += 1
    model = quality.estimate(dict(counts))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    assert model.tables[0, 0, 0] == pytest.approx(0.5, abs=0.06)
    assert model.posterior("bb---gggg") < 0.5 < model.posterior("-----gggg")
    assert quality.estimate({}).prior == 0.5


def test_scorer_learns():
    rows = []
    for i in range(200):
        text = "the cat sat. On a mat" if i % 2 else "THE!! CAT!! SAT!!"
        b, n = np.unique(quality.hashed(text), return_counts=True)
        rows.append((b.tolist(), n.tolist(), float(i % 2)))
    scorer = quality.train(rows)
    assert scorer.score("a dog ran. It was far") > 0.7 > 0.3 > scorer.score("DOG!! RAN!! FAR!!")
    assert 0 <= scorer.score(None) <= 1
    assert quality.train([]).score("x") > 0.5


def test_quality(spark, docs, cases, no_docs):
    junk = [(1000 + i, ("BUY!! NOW!! " * 60 if i % 2 else "word " * 90), "en", "a", 1, "", "", "") for i in range(20)]
    more = docs.union(spark.createDataFrame(junk, docs.schema))
    got = quality.classify(more).collect()
    assert Counter(r.doc_id for r in got) == Counter(c[0] for c in [*cases, *junk])
    keep = {r.doc_id: r.keep for r in got}
    assert not any(keep[j[0]] for j in junk)
    assert keep[16] and keep[3] and all(keep[100 + i] for i in range(10, 40))
    assert {tuple(r) for r in quality.classify(more).collect()} == {tuple(r) for r in got}
    kept = quality.without_bad(more)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000").isEmpty()
    assert quality.classify(no_docs).count() == 0
