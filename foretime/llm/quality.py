"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or nothing (-1) on a text. They overlap: each kind of bad
text is seen by two or more of them, so a labeller that errs alone is outvoted. Expectation-maximisation
over the counts of vote patterns, of which there are at most 3 to the power of the number of
labellers, estimates how often each labeller votes bad on good texts and on each kind of bad ones, and
gives each pattern its posterior of being good. The rates are free: a weak prior of a few counts keeps
them off 0 and 1. Silence is no evidence. These posteriors, not any given label, train a linear scorer
on hashed features of words (shape and ending) and of the text's repetition and length.

The pattern counts cover all documents. The scorer is trained on a sample of at most
MAX_SAMPLE documents, lowest hash of the id first; every whole text is scored.

Cases: on a null or empty text the labeller of length votes bad and its score is 0. A null id is
scored. Rows that repeat are scored alike. An empty table gives an empty result. Other columns
are ignored by `score_documents`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_of

DIM = 1 << 14
MAX_SAMPLE = 8_000
#: Entries of a task's table of words.
TABLE_WORDS = 500_000
#: Words of a stretch in which distinct words are counted.
STRETCH = 128
#: Pseudo-counts of a labeller's good and bad votes in each class: right in 80 %.
PRIOR_VOTES = 5.0
#: Values of the features of repetition and of length.
BUCKET_VALUES = np.array([1.0, 0.3])
LABELLERS = ("length", "sign_words", "sign_characters", "capital_words", "capital_letters", "repeats", "distinct", "sentences", "separators", "exclamations", "word_length")

#: The labellers that look at each kind of bad text: fragments, signs, capitals, repetition, lists.
KINDS = [[LABELLERS.index(x) for x in kind] for kind in (("length", "sentences", "word_length"), ("sign_words", "sign_characters"), ("capital_words", "capital_letters", "exclamations"), ("repeats", "distinct"), ("separators", "sign_words"))]


class Words:
    """For each word: the counts that votes need, and, where features are wanted, the indices of its two hashed features."""

    COUNTS = ("chars", "letters", "upper", "capitals", "signs", "sign_words", "ends", "separators", "shouts")

    def __init__(self, features: bool = True):
        self.features = features
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.stats = np.zeros((0, len(self.COUNTS)), np.float32)
        self.hashed = np.zeros((0, 2), np.int64)

    def learn(self, words: set[str]) -> None:
        """Rows for those words that the table lacks; it is emptied first when it has TABLE_WORDS entries."""
        if len(self.row) > TABLE_WORDS:
            self.clear()
        new = [w for w in words if w not in self.row]
        if not new:
            return
        stats, hashed = [], []
        for w in new:
            letters = len(w) if w.isalpha() else sum(map(str.isalpha, w))
            upper = 0 if w.islower() else sum(map(str.isupper, w))
            digits = 0 if letters == len(w) else sum(map(str.isdigit, w))
            signs = len(w) - letters - digits - (w[-1] in ".,;:?!")
            stats.append((len(w), letters, upper, letters > 1 and upper == letters, signs, signs > 0, w[-1] in ".?", w in ("|", "•", "»"), w.endswith("!!")))
            if self.features:
                hashed.append((xxhash.xxh32_intdigest("s" + _shape(w)) % DIM, xxhash.xxh32_intdigest("e" + w[-3:]) % DIM))
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        self.stats = np.concatenate([self.stats, np.array(stats, np.float32)])
        if self.features:
            self.hashed = np.concatenate([self.hashed, np.array(hashed, np.int64)])


def _shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other signs stay, up to three."""
    if word.isalpha() and (word.islower() or word[0].isupper() and word[1:].islower()):
        return "a" if word.islower() else "Aa"
    out = []
    for c in word[:40]:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else c
        if not out or out[-1] != kind or kind not in "aA0w" and out[-3:] != [kind] * 3:
            out.append(kind)
    return "".join(out)


@dataclass
class Examined:
    """Of some texts: each token's text and row in the table of words, each text's number of words and votes."""

    text: np.ndarray
    rows: np.ndarray
    total: np.ndarray
    votes: np.ndarray  # text, labeller: -1, 0 or 1
    repeats: np.ndarray  # share of words that repeat the one before

    def buckets(self) -> np.ndarray:
        """The indices of each text's features of repetition and of length."""
        return np.c_[1 + np.minimum((self.repeats * 10).astype(int), 9), 11 + np.minimum(np.log2(self.total + 1).astype(int), 15)]


def examine(texts: list[str], table: Words) -> Examined:
    sequences = [t.split() for t in texts]
    total = np.array([len(s) for s in sequences], float)
    table.learn(set().union(*sequences))
    rows = np.fromiter(map(table.row.__getitem__, chain.from_iterable(sequences)), np.int64, int(total.sum()))
    text = np.repeat(np.arange(len(texts)), total.astype(int))
    count = {name: np.bincount(text, table.stats[rows, k], len(texts)) for k, name in enumerate(table.COUNTS)}
    again = (rows[1:] == rows[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[1:][again], minlength=len(texts)) / np.maximum(total, 1)
    distinct = np.array([sum(len(set(s[k : k + STRETCH])) for k in range(0, len(s), STRETCH)) for s in sequences], float) / np.maximum(total, 1)
    words, chars, letters = (np.maximum(x, 1) for x in (total, count["chars"], count["letters"]))
    some, many = total > 0, total >= 20

    def vote(good: np.ndarray, bad: np.ndarray, may: np.ndarray) -> np.ndarray:
        return np.where(may & good, 1, np.where(may & bad, 0, -1))

    def low(x: np.ndarray, good: float, bad: float, may: np.ndarray = some) -> np.ndarray:
        return vote(x < good, x > bad, may)

    mean = chars / words
    votes = [
        vote(total >= 40, total < 5, total >= 0),
        low(count["sign_words"] / words, 0.05, 0.2),
        low(count["signs"] / chars, 0.02, 0.08),
        low(count["capitals"] / words, 0.05, 0.2),
        low(count["upper"] / letters, 0.1, 0.3),
        low(repeats, 0.05, 0.15),
        vote(distinct > 0.5, distinct < 0.4, many),
        vote((count["ends"] / words > 0.02) & (count["ends"] / words < 0.35), count["ends"] / words < 0.005, many),
        low(count["separators"] / words, 0.01, 0.1),
        low(count["shouts"] / words, 0.01, 0.05),
        vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14), some),
    ]
    return Examined(text, rows, total, np.array(votes).T.reshape(len(texts), len(LABELLERS)), repeats)


def _patterns(votes: np.ndarray) -> list[str]:
    signs = np.array(list("-01"))[votes + 1]
    return ["".join(x) for x in signs]


@dataclass
class LabelModel:
    """shares: of good texts, then of each kind of bad ones. bad[c, k]: chance that labeller k, when it votes, votes bad on a text of class c."""

    shares: np.ndarray
    bad: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.shares[0])

    def of_classes(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each class (column), given votes (row) of -1, 0 or 1."""
        log = np.log(self.shares) + (votes == 0) @ np.log(self.bad).T + (votes == 1) @ np.log(1 - self.bad).T
        post = np.exp(log - log.max(1, keepdims=True))
        return post / post.sum(1, keepdims=True)

    def posterior(self, pattern: str) -> float:
        return float(self.of_classes(_votes([pattern]))[0, 0])


def _votes(patterns: list[str]) -> np.ndarray:
    return np.array([["-01".index(c) - 1 for c in p] for p in patterns])


def expectation_maximisation(counts: dict[str, int], kinds: list[list[int]] = KINDS, steps: int = 200, prior: float = 0.85) -> LabelModel:
    """From the counts of vote patterns. On bad texts of one kind the labellers in kinds that look at it start as right in 80 % of their votes, all others as on good texts; the start settles what the classes mean."""
    votes = _votes(list(counts))
    n = np.array(list(counts.values()), float)
    start = np.full((1 + len(kinds), votes.shape[1]), 0.2)
    for c, at in enumerate(kinds):
        start[1 + c, at] = 0.8
    model = LabelModel(np.array([prior, *[(1 - prior) / len(kinds)] * len(kinds)]), start)
    for _ in range(steps):
        weight = model.of_classes(votes) * n[:, None]
        found, passed = weight.T @ (votes == 0), weight.T @ (votes == 1)
        model = LabelModel((weight.sum(0) + 1) / (n.sum() + len(weight[0])), (found + PRIOR_VOTES * start) / (found + passed + PRIOR_VOTES))
    return model


def fit_labellers(docs: DataFrame) -> LabelModel:
    """The label model of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words(features=False)
        for batch in slices(batches, 0):
            counts = Counter(_patterns(examine(batch.column(0).to_pylist(), table).votes))
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return expectation_maximisation({r["pattern"]: r["n"] for r in sorted(rows)} or {"-" * len(LABELLERS): 1})


def train_scorer(docs: DataFrame, labels: LabelModel, max_sample: int = MAX_SAMPLE, steps: int = 200) -> np.ndarray:
    """DIM weights and a bias, from the posteriors of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for batch in slices(batches):
            found = examine(batch.column(1).to_pylist(), table)
            n = len(found.total)
            # (text, feature) pairs of words, of both buckets
            key = np.r_[(found.text[:, None] * DIM + table.hashed[found.rows]).ravel(), (np.arange(n)[:, None] * DIM + found.buckets()).ravel()]
            value = np.r_[np.repeat(1 / found.total[found.text], 2), np.tile(BUCKET_VALUES, n)]
            pairs, inverse = np.unique(key, return_inverse=True)
            ends = np.searchsorted(pairs, np.arange(n + 1) * DIM).astype(np.int32)
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, t))
            yield pa.record_batch([pa.array(_patterns(found.votes)), lists(pairs % DIM, pa.int32()), lists(np.bincount(inverse, value), pa.float32())], ["pattern", "at", "value"])

    picked = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")  # at most max_sample ids
    rows = sorted((r["pattern"], r["at"], r["value"]) for r in sample.mapInArrow(run, "pattern string, at array<int>, value array<float>").collect())
    w = np.zeros(DIM + 1)
    if not rows:
        return w
    target = np.array([labels.posterior(p) for p, _, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for _, a, _ in rows])
    at, value = (np.concatenate([np.array(r[k]) for r in rows]) for k in (1, 2))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        z = np.bincount(row, w[at] * value, len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.r_[np.bincount(at, error[row] * value, DIM), error.sum()] + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return w


def score_documents(docs: DataFrame, labels: LabelModel, weights: np.ndarray) -> DataFrame:
    """doc_id, votes, posterior, score: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((labels, weights))  # DIM + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = Words(), {}
        labels, weights = sent.value
        for batch in slices(batches):
            found = examine(batch.column(1).to_pylist(), table)
            patterns = _patterns(found.votes)
            known.update((p, labels.posterior(p)) for p in set(patterns).difference(known))
            of_words = np.bincount(found.text, weights[table.hashed].sum(1)[found.rows], len(found.total)) / np.maximum(found.total, 1)
            z = of_words + weights[found.buckets()] @ BUCKET_VALUES + weights[-1]
            score = np.where(found.total > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.record_batch([batch.column(0), pa.array(patterns, pa.string()), pa.array([known[p] for p in patterns], pa.float64()), pa.array(score, pa.float64())], ["doc_id", "votes", "posterior", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, votes string, posterior double, score double")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score of every document, with models fitted to docs."""
    labels = fit_labellers(docs)
    return score_documents(docs, labels, train_scorer(docs, labels))
