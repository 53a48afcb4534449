"""Toxicity by non-negative positive-unlabelled learning.

Known are toxic examples (P) and texts of which nothing is known (U). With the class
prior p the risk of a classifier g is

    p * R_P(g, +1) + max(0, R_U(g, -1) - p * R_P(g, -1)):

the second part estimates the risk on clean texts, which can't be negative; where the
estimate is, the step goes the other way. The classifiers are linear, trained with
numpy by Adam on the logistic loss, each on another half of U; a score is the
logistic function of their mean.

Features are the words of a text and their first 4 to 7 letters: that one is there, that
it is there twice or three times, and that it makes up 0.5 % of the words or more, so
that length alone makes no text toxic. Only features of at least MIN_P toxic
examples are weighed, the FEATURES best of them.

Training reads at most MAX_P toxic examples and MAX_U of all documents, whose labels, if any, are
hidden, lowest hash of the id first; scoring reads every whole text. The class prior is the share of toxic rows among the
labelled ones; no other label is looked at.

Cases: a null or empty text has no features and gets the score of the bias. A null id is
scored and never trained on. Rows that repeat are scored alike. Without toxic
examples all scores are 0. An empty table gives an empty result. Other columns are
ignored by `score_documents` and carried along by `drop_toxic`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_of

MAX_P = 2_000
MAX_U = 6_000
MIN_P = 4
#: Candidates among the features of P, and those that get weights.
CANDIDATES = 20_000
FEATURES = 1_500
PREFIXES = (4, 5, 6, 7)
CLASSIFIERS = 3
#: Entries of a task's table of words.
TABLE_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_NONE: list[str] = []


def _grams(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) >= k)]


def _levels(gram: str, n: int, words: int) -> list[str]:
    """The features that a gram found n times among so many words gives."""
    return [gram, *([gram + "2"] if n > 1 else []), *([gram + "3"] if n > 2 else []), *([gram + "%"] if n * 200 >= words else [])]


def features(text: str, grams_of=_grams) -> set[str]:
    """All features of a text; grams_of may leave out what has no weight."""
    words = Counter(_WORD.findall(text.lower()))
    total, grams = sum(words.values()), Counter()
    for word, n in words.items():
        for gram in grams_of(word):
            grams[gram] += n
    return {x for gram, n in grams.items() for x in _levels(gram, n, total)}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0

    def score(self, text: str) -> float:
        return Scorer(self).score(text)


class Scorer:
    """A model with a table of the words met so far: for each the grams that have weights. It belongs to one task."""

    def __init__(self, model: Model):
        self.model, self.grams, self.table = model, {x.rstrip("23%") for x in model.weights}, {}

    def grams_of(self, word: str) -> list[str]:
        found = self.table.get(word)
        if found is None:
            if len(self.table) > TABLE_WORDS:
                self.table.clear()
            found = self.table[word] = [g for g in _grams(word) if g in self.grams] or _NONE
        return found

    def score(self, text: str) -> float:
        z = self.model.bias + sum(self.model.weights.get(x, 0.0) for x in features(text, self.grams_of))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, seed: int, steps: int = 300, decay: float = 2e-4) -> np.ndarray:
    """Weights of a linear classifier (the last one is the bias) from rows of positives and unlabelled rows."""
    rnd = np.random.default_rng(seed)
    p, u = (np.c_[x, np.ones(len(x), np.float32)] for x in (p, u[rnd.permutation(len(u))[: max(1, (len(u) + 1) // 2)]]))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for k in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()  # the estimated risk on clean texts
        as_clean = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        as_toxic = -prior * (p.T @ sigmoid(-zp)) / len(p)
        grad = as_toxic + as_clean if clean >= 0 else -as_clean
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame | None = None, max_p: int = MAX_P, max_u: int = MAX_U) -> Model:
    """A model from the toxic rows of labels (doc_id, toxic) and from unlabelled (doc_id): documents taken as if nothing was known of them, all of docs by default."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return Model()
    some = (docs if unlabelled is None else unlabelled).select("doc_id").filter("doc_id IS NOT NULL").distinct()
    picked = first(known.filter("toxic = 1").select("doc_id").distinct(), max_p).withColumn("p", F.lit(True)).union(first(some, max_u).withColumn("p", F.lit(False)))
    # at most max_p + max_u ids of 9 bytes
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id").select("p", "text").persist()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = Counter(x for text in batch.column(1).to_pylist() for x in features(text))
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    top = sample.filter("p").mapInArrow(listed, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_P)
    names = [r["feature"] for r in top.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()]
    at = {x: k for k, x in enumerate(names)}
    grams = {x.rstrip("23%") for x in names}

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [np.sort(np.array([at[x] for x in features(text, lambda w: [g for g in _grams(w) if g in grams]) if x in at], ">i4")).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], ["p", "at"])

    # four bytes for each feature of the at most max_p + max_u rows
    rows = sorted((r["p"], bytes(r["at"])) for r in sample.mapInArrow(matched, "p boolean, at binary").collect())
    sample.unpersist()
    is_p = np.array([p for p, _ in rows], bool)
    if not is_p.any() or not names:
        return Model()
    n_p, n_u = max(1, is_p.sum()), max(1, (~is_p).sum())
    in_p, in_u = np.zeros(len(names)), np.zeros(len(names))
    for p, found in rows:
        (in_p if p else in_u)[np.frombuffer(found, ">i4")] += 1
    a, b = in_p / n_p, in_u / n_u
    z = (a - b) / np.sqrt(a * (1 - a) / n_p + b * (1 - b) / n_u + 1e-9)  # how surely a feature is more frequent in P
    kept = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    kept = kept[z[kept] > 2]
    if not len(kept):
        return Model()
    column = np.full(len(names), -1)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(rows), len(kept)), np.float32)
    for r, (_, found) in enumerate(rows):
        own = column[np.frombuffer(found, ">i4")]
        x[r, own[own >= 0]] = 1
    del rows
    prior = min(max(float(prior), 1e-4), 0.9)
    cut = len(x) - int(is_p.sum())  # rows are sorted: P comes last, and parts of x are no copies
    w = np.mean([nnpu(x[cut:], x[:cut], prior, seed) for seed in range(CLASSIFIERS)], 0)
    return Model({names[k]: float(w[c]) for c, k in enumerate(kept)}, float(w[-1]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under threshold; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, at):
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no training may use: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
