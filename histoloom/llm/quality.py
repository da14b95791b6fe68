"""Quality by weak labels: heuristics, their accuracies, and a hashed scorer.

Nine heuristics vote good, bad or nothing on each document. They overlap and
err; expectation-maximisation estimates, from how often each combination of
votes comes in the whole corpus, what each vote is worth and how probable it is
that a document is good. Those probabilities train a linear scorer over hashed
word shapes, which sees every word and so also documents on which no heuristic
votes. No human label is used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histoloom.llm import memos

BAD, GOOD, NONE = "b", "g", "-"
SYMBOLS = "#$%&*|<>{}[]~^=+\\"
BUCKETS = 1 << 14


@dataclass
class Facts:
    text: str
    words: list[str] = field(init=False)

    def __post_init__(self):
        self.words = self.text.split()
        self.n = max(1, len(self.words))


def _defect(share: float, bad: float) -> str:
    """A sign of bad text. Its absence says nothing: text can be bad otherwise."""
    return BAD if share >= bad else NONE


def _between(value: float, low: float, high: float, bad_low: float, bad_high: float) -> str:
    """Good from ``low`` to ``high``, bad outside ``bad_low`` to ``bad_high``."""
    return GOOD if low <= value <= high else BAD if value < bad_low or value > bad_high else NONE


#: Name and vote of each heuristic. Shares are per word.
LABELLERS: tuple[tuple[str, Callable[[Facts], str]], ...] = (
    ("symbols", lambda x: _defect(sum(map(x.text.count, SYMBOLS)) / x.n, 0.1)),
    ("upper case", lambda x: _defect(sum(w.isupper() and len(w) > 1 for w in x.words) / x.n, 0.2)),
    ("repeated words", lambda x: _defect(sum(map(eq, x.words, x.words[1:])) / x.n, 0.08)),
    ("columns", lambda x: _defect(x.text.count("|") / x.n, 0.1)),
    ("exclamations", lambda x: _defect(x.text.count("!") / x.n, 0.15)),
    ("sentences", lambda x: _between((x.text.count(".") + x.text.count("?")) / x.n, 0.03, 0.34, 0.005, 0.6)),
    ("vocabulary", lambda x: _between(len(set(x.words)) / x.n**0.75, 0.8, 9.0, 0.4, 99.0)),
    ("length", lambda x: _between(len(x.words), 40, 1e9, 3, 1e9)),
    ("word length", lambda x: _between(len(x.text) / x.n, 4.4, 8.0, 1.7, 10.7)),
)


def votes(text: str | None) -> str:
    facts = Facts(text or "")
    return "".join(labeller(facts) for _, labeller in LABELLERS)


@dataclass
class LabelModel:
    """Share of good documents, and P(vote | class) of each heuristic."""

    prior: float
    tables: np.ndarray  # (heuristics, classes bad and good, votes b g -)

    def posterior(self, pattern: str) -> float:
        log = np.log([1 - self.prior, self.prior])
        for table, vote in zip(self.tables, pattern, strict=True):
            log = log + np.log(table[:, "bg-".index(vote)])
        log -= log.max()
        return float(np.exp(log[1]) / np.exp(log).sum())

    def accuracies(self) -> dict[str, float]:
        """P(vote is right | it votes) of each heuristic."""
        share = np.array([1 - self.prior, self.prior])[:, None] * self.tables[:, :, :2]
        return {name: float(np.trace(x) / x.sum()) for (name, _), x in zip(LABELLERS, share, strict=True)}


def estimate(counts: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their numbers.

    It starts from documents without a bad vote as good. Heuristics are taken as independent
    given the class; one pseudo-document of each vote keeps every probability
    above zero.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([["bg-".index(v) for v in p] for p in patterns], int).reshape(len(patterns), len(LABELLERS))
    one = np.eye(3)[seen]
    good = np.where((seen == 0).any(1), 0.05, 0.95)
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        share = np.stack([n * (1 - good), n * good])
        tables = np.einsum("cp,plv->lcv", share, one) + 1.0
        after = LabelModel(float((share[1].sum() + 1) / (n.sum() + 2)), tables / tables.sum(2, keepdims=True))
        moved = abs(after.tables - model.tables).max() if len(patterns) else 0.0
        model = after
        log = np.log([[1 - model.prior], [model.prior]]) + np.einsum("plv,lcv->cp", one, np.log(model.tables))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if moved < 1e-7:
            break
    return model


_SHAPE = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "0")})


class _Shapes(dict):
    """Word to a number of its shape: kinds of characters, runs cut to two."""

    def __missing__(self, word: str) -> int:
        if word.isalpha() and word.islower() and len(word) > 1:
            return self["aa"] if word != "aa" else self._keep(word, "aa")
        kinds = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in word.translate(_SHAPE))
        out = []
        for c in kinds:
            if out[-2:] != [c, c]:
                out.append(c)
        return self._keep(word, "".join(out))

    def _keep(self, word: str, shape: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = zlib.crc32(shape.encode()) & 0x7FFFFFFF
        return got


_shapes = _Shapes()


def hashed(text: str | None) -> np.ndarray:
    """Buckets of a text's features: shapes of words, of pairs of words, and
    repetitions. An empty text has one bucket of its own."""
    memos.only("shapes")
    memos.remember("shapes", _shapes.clear)
    words = (text or "").split()
    if not words:
        return np.zeros(1, np.int64)
    shape = np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))
    pairs = shape[:-1] * 1_000_003 + shape[1:]
    same = np.fromiter(map(eq, words, words[1:]), np.int64, len(words) - 1)
    keys = np.concatenate([shape * 3, pairs * 3 + 1, same * 3 + 2])
    return (keys * 0x5851F42D4C957F2D >> 33) % (BUCKETS - 1) + 1


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability that a text is good: logistic in the mean weight."""
        return float(1 / (1 + np.exp(-np.clip(self.weights[hashed(text)].mean() + self.bias, -30, 30))))


def train(rows: list[tuple[list[int], list[int], float]], rounds: int = 300, rate: float = 1.0, pull: float = 1e-5) -> Scorer:
    """Logistic regression (Adagrad, whole batches) on feature shares.

    ``rows``: buckets, how often each comes, and the label probability.
    """
    if not rows:
        return Scorer(np.zeros(BUCKETS), 2.0)
    sizes = np.array([len(r[0]) for r in rows])
    of = np.repeat(np.arange(len(rows)), sizes)
    bucket = np.concatenate([r[0] for r in rows]).astype(np.int64)
    share = np.concatenate([np.array(r[1]) / sum(r[1]) for r in rows])
    y = np.array([r[2] for r in rows])
    w, b = np.zeros(BUCKETS), 0.0
    past, past_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[bucket] * share, len(rows)) + b, -30, 30)))
        off = (p - y) / len(rows)
        slope = np.bincount(bucket, off[of] * share, BUCKETS) + pull * w
        past += slope**2
        past_b += off.sum() ** 2
        w -= rate * slope / np.sqrt(past)
        b -= rate * 0.1 * off.sum() / np.sqrt(past_b)
    return Scorer(w, float(b))


@dataclass
class Model:
    labels: LabelModel
    scorer: Scorer


def _bound(keys: DataFrame, sample: int) -> tuple[int, int]:
    """The ``sample``th smallest hash ``k``, and how many of its rows count.

    Distinct hashes are spread evenly, so those in the first share of the range
    that should hold ``sample`` rows are few; the share grows where repeated
    rows lie beyond it. The driver sees some multiples of ``sample`` numbers,
    whatever the number of rows and partitions.
    """
    rows = keys.count()
    share = (sample + 6 * sample**0.5 + 10) / max(1, rows)
    while rows:
        top = min((1 << 63) - 1, int(share * 2**64) - (1 << 63))
        counts = sorted(map(tuple, keys.where(F.col("k") <= top).groupBy("k").count().collect()))
        left = sample
        for k, n in counts:
            if n >= left:
                return k, left
            left -= n
        if share >= 1:
            return (counts[-1][0], counts[-1][1]) if counts else (0, 0)
        share *= 4
    return 0, 0


def fit(docs: DataFrame, sample: int = 10_000, most_features: int = 512) -> Model:
    """Vote counts cover all of ``docs``; the scorer learns from at most
    ``sample`` documents, those of the smallest hashes of doc_id and text, and
    of each from its ``most_features`` commonest features (few documents have
    more), so what the driver holds is bounded. Rows that tie at the last hash
    are equal, so it does not matter which of them are taken."""

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos.only("shapes")
        for batch in batches:
            found = Counter(map(votes, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    # At most 3 to the 9th patterns.
    counts = docs.select("text").mapInArrow(voted, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    labels = estimate({r[0]: r[1] for r in counts.collect()})
    key = F.xxhash64("doc_id", "text")
    bodies = docs.select("text", key.alias("k"))
    last, ties = _bound(bodies.select("k"), sample)
    some = bodies.limit(0)
    if ties:
        some = bodies.where(F.col("k") < last).union(bodies.where(F.col("k") == last).limit(ties))

    def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        bucket, n = np.unique(hashed(text), return_counts=True)
        most = np.sort(np.argsort(-n, kind="stable")[:most_features])
        return bucket[most], n[most]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*counted(x), labels.posterior(votes(x))) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.float64())], names=["b", "n", "y"])

    rows = some.select("text").mapInArrow(features, "b array<long>, n array<long>, y double").collect()
    return Model(labels, train(sorted((r.b, r.n, r.y) for r in rows)))


def judged(model: Model, text: Column) -> Column:
    """struct<votes, posterior, score> of a text."""

    @F.pandas_udf("votes string, posterior double, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        memo: dict[str, float] = {}
        rows = []
        for x in texts:
            pattern = votes(x)
            if pattern not in memo:
                memo[pattern] = model.labels.posterior(pattern)
            rows.append((pattern, memo[pattern], model.scorer.score(x)))
        return pd.DataFrame(rows, columns=["votes", "posterior", "score"])

    return judge(text)


def scores(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.scorer.score(x) for x in texts], dtype="float64")

    return scored(text)


def classify(docs: DataFrame, threshold: float = 0.5, sample: int = 10_000) -> DataFrame:
    """doc_id, votes, posterior, score, keep of every row of ``docs``.

    Null texts count as empty; null doc_ids and repeated rows stay; other
    columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, sample)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(model, F.col("text")).alias("j"))
    return out.select("doc_id", "j.votes", "j.posterior", "j.score", (F.col("j.score") >= threshold).alias("keep"))


def without_bad(docs: DataFrame, threshold: float = 0.5, sample: int = 10_000) -> DataFrame:
    """``docs`` less the rows whose score is below the threshold.

    Null texts count as empty; rows of a null doc_id and repeated rows are
    judged by their text like any other; all columns come back as they were,
    whatever their names; an empty table gives no rows.
    """
    return docs.where(scores(fit(docs, sample), F.col("text")) >= threshold)
