"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps words to symbols: insult, threat, target, negation, reported
speech, other. Small machines read a clause's symbols - one remembers that an
insult or a threat came, one that a target came, one whether each came within
reach of a negation, one that speech is reported - and are composed into one
machine whose final state says what was matched. Each final state has a weight;
a clause scores that weight times its heaviest word, so the same word counts
less where it is denied or quoted and more where it is aimed at someone.

Weights of words are smoothed log-odds of labelled documents. Insults are
inflected and other languages have their own, so stems (beginnings of words) are
learned as well as words. The score of a document is a logistic function of the
logarithm of its clauses' sum, fitted to the same labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histoloom.llm import memos, shared

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# The words the grammar knows before it has seen a label.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash clown clowns worthless pathetic disgusting imbecile "
    "dumb dumbass jerk fool foolish garbage vermin filth filthy ugly coward creep freak pig bastard bitch asshole retard"
).split()
THREATS = "kill hurt destroy beat punch stab shoot attack murder strangle burn smash".split()
TARGETS = "you your yours you're u ur he she they him her them his their this these that those people everyone".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't wouldn't nobody without hardly".split()
REPORTS = "said says say saying wrote writes called calls claimed claims reported reports quoted quotes told allegedly".split()

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
ENDS = frozenset(".!?;\n")
#: Lengths of stems, in letters.
STEMS = (4, 5, 6)


# Machines: start state, and the next state for a state and a symbol.


@dataclass(frozen=True)
class Machine:
    start: object
    step: Callable[[object, int], object]


#: 0: nothing, 1: an insult came, 2: a threat came, 3: both.
MATTER = Machine(0, lambda s, x: s | (1 if x == INSULT else 2 if x == THREAT else 0))
#: 1 once a target came.
AIMED = Machine(0, lambda s, x: s | (x == TARGET))
#: Words that a negation still reaches, and whether an insult or threat came out of its reach.
DENIED = Machine((0, 0), lambda s, x: (4, s[1]) if x == NEGATION else (max(0, s[0] - 1), s[1] | (x in (INSULT, THREAT) and s[0] == 0)))
#: 1 once speech was reported before anything else mattered.
QUOTED = Machine((0, 0), lambda s, x: (1, s[1]) if x == REPORT and not s[1] else (s[0], s[1] | (x in (INSULT, THREAT))))


@dataclass(frozen=True)
class Composed:
    """The product of machines as a table: next[state][symbol]."""

    table: tuple[tuple[int, ...], ...]
    states: tuple[tuple, ...]

    def run(self, symbols: Iterable[int]) -> int:
        state = 0
        for x in symbols:
            state = self.table[state][x]
        return state


def compose(*machines: Machine, symbols: int = 6) -> Composed:
    start = tuple(m.start for m in machines)
    states, number, table = [start], {start: 0}, []
    for state in states:
        row = []
        for x in range(symbols):
            after = tuple(m.step(s, x) for m, s in zip(machines, state, strict=True))
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
        table.append(tuple(row))
    return Composed(tuple(table), tuple(states))


def clause_weight(state: tuple) -> float:
    """Of a final state (MATTER, AIMED, DENIED, QUOTED)."""
    matter, aimed, (_, plain), (quoted, _) = state
    if not matter:
        return 0.0
    weight = 1.0 if matter & 1 else 0.4  # a threat word alone is weak
    if aimed:
        weight += 0.5 if matter & 1 else 0.6
    if not plain:
        weight *= 0.3
    if quoted:
        weight *= 0.6
    return weight


GRAMMAR = compose(MATTER, AIMED, DENIED, QUOTED)
WEIGHTS = tuple(clause_weight(s) for s in GRAMMAR.states)
_PLAIN = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)


@dataclass
class Model:
    """words, stems: weight of each; a, b: of the logistic function."""

    words: dict[str, float]
    stems: dict[str, float]
    a: float
    b: float
    threats: frozenset = frozenset(THREATS)
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def symbol(self, word: str) -> tuple[int, float]:
        """Of a word in lower case, with its weight."""
        got = self.known.get(word)
        if got is None:
            weight = self.words.get(word, 0.0)
            for n in STEMS:
                if len(word) >= n:
                    weight = max(weight, self.stems.get(word[:n], 0.0))
            got = (THREAT if word in self.threats else INSULT, weight) if weight > 0 else (_PLAIN.get(word, OTHER), 0.0)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = got
        return got

    def evidence(self, text: str | None) -> float:
        """Sum over clauses of the matched weight times the heaviest word's."""
        total, clause, heaviest = 0.0, [], 0.0
        symbol = self.symbol
        for token in TOKEN.findall((text or "").lower()):
            if token in ENDS:
                if heaviest:
                    total += WEIGHTS[GRAMMAR.run(clause)] * heaviest
                clause, heaviest = [], 0.0
            else:
                x, weight = symbol(token)
                clause.append(x)
                if weight > heaviest:
                    heaviest = weight
        return total + (WEIGHTS[GRAMMAR.run(clause)] * heaviest if heaviest else 0.0)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * math.log1p(self.evidence(text)) + self.b))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(text: str) -> set[str]:
    """Words ("word") and stems ("stem*") of a text."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) >= n}


def _counted(rows: DataFrame, only: frozenset | None) -> DataFrame:
    """Number of texts that have a feature, in part sums: feature, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                has = _features(text or "")
                found.update(has if only is None else has & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

    parts = rows.mapInArrow(count, "feature string, n long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, start: tuple[float, float] = (2.0, -3.0), pull: float = 1.0) -> tuple[float, float]:
    """a, b by Newton's method, drawn to ``start`` with weight ``pull``."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.array(start)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + pull * (w - start)
        curve = design.T @ (design * (p * (1 - p))[:, None]) + pull * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w - np.clip(step, -1, 1)
        if abs(step).max() < 1e-8:
            break
    return max(0.05, float(w[0])), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, most_features: int = 50_000) -> Model:
    """Learns from at most ``most_labels`` labelled rows that are not held out.

    Those of the smallest hashes of doc_id are taken. Of several labels of one
    doc_id the highest counts, of several texts the first in order; null labels
    count as none. Copies would make any
    of their words look telling, so of texts with the same least shingle hash
    only one counts. Without labels the grammar's own words are left. The
    lexicon is chosen among the ``most_features`` commonest words and stems of
    these rows' toxic texts, so that what the driver holds is bounded.
    """
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("is_toxic"))
    some = clean.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most most_labels rows of 16 bytes
    texts = labelled.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("is_toxic").alias("is_toxic"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from histoloom.llm.simhash import shingle_hashes

        for batch in batches:
            least = [min(shingle_hashes(x, 5), default=0) >> 1 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=["text", "is_toxic", "least"])

    rows = texts.select("text", "is_toxic").mapInArrow(sketched, "text string, is_toxic int, least long")
    sample = shared.written(rows.groupBy("least", "is_toxic").agg(F.min("text").alias("text")), "labelled")
    size = {r[0]: r[1] for r in sample.groupBy("is_toxic").count().collect()}
    toxic, fine = size.get(1, 0), size.get(0, 0)
    bar = max(4, toxic // 100)
    common = _counted(sample.where("is_toxic = 1").select("text"), None)
    counts = {r[0]: r[1] for r in common.where(F.col("n") >= bar).orderBy(F.desc("n"), "feature").limit(most_features).collect()}
    own = set(INSULTS) | set(THREATS)
    for r in common.where(F.col("feature").isin(sorted(own))).collect():
        counts[r[0]] = r[1]
    among = frozenset(counts) | own
    against = {r[0]: r[1] for r in _counted(sample.where("is_toxic = 0").select("text"), among).collect()}

    def weight(feature: str) -> float:
        before = 3.0 if feature in own else 0.0  # what the grammar's own words bring along
        t, c = counts.get(feature, 0) + before + 0.5, against.get(feature, 0) + 0.5
        return math.log(t / (toxic + before + 1)) - math.log(c / (fine + before + 1)) if toxic and fine else math.log(t / c)

    told = {f for f, n in counts.items() if n >= bar and against.get(f, 0) <= 0.05 * n}
    stems = {f[:-1]: weight(f) for f in told if f[-1] == "*"}
    stems = {f: w for f, w in stems.items() if not any(f[:n] in stems for n in STEMS if n < len(f))}
    words = {f: weight(f) for f in told if f[-1] != "*"}
    words |= {f: max(0.0, weight(f)) for f in own}
    model = Model(words, stems, 2.0, -3.0)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [math.log1p(model.evidence(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

    pairs = np.array(sorted(tuple(r) for r in sample.select("text", "is_toxic").mapInArrow(seen, "x double, y int").collect())).reshape(-1, 2)
    shared.drop(sample)
    if toxic and fine:
        model.a, model.b = _logistic(pairs[:, 0], pairs[:, 1])
    return model


def scores(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        memos.only()
        return pd.Series([model.score(x) for x in texts], dtype="float64")

    return scored(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null texts score as empty ones; a null doc_id is not held out; repeated rows
    come as often as they are there; other columns are ignored; an empty table
    gives no rows. A score depends on nothing but the text.
    """
    model = fit(docs, labels, **options)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scores(model, F.col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` less the rows whose score reaches the threshold.

    Null texts score as empty ones; rows of a null doc_id and repeated rows are
    judged by their text like any other; all columns come back as they were,
    whatever their names; an empty table gives no rows.
    """
    return docs.where(scores(fit(docs, labels, **options), F.col("text")) < threshold)
