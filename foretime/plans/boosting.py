"""Second-order boosted trees on an offset, fitted by Spark aggregations, and the two-model scorer made of them.

Every round, the gradients of the loss are taken anew at offset + all trees so far. A level of a tree is one aggregation:
tasks add up gradient, curvature and rows by (node, feature, bin) over Arrow batches, a grouped shuffle merges
them, and the driver, which sees nodes * features * bins sums and no rows, picks the cuts. Gradients are summed as
whole multiples of 2^-UNIT_BITS, so the same trees come out however the rows are dealt or tasks run again. The margins are
written to the shared folder every REWRITE rounds; between, a task runs the few trees that are newer.

Growth is by levels to a fixed depth. Values go to bins by quantile edges; a missing value has a bin of its own below all others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.plans.models import _each_fold, core_and_tail, market_logit, temperature
from foretime.sources.shared import written

UNIT_BITS = 24
REWRITE = 8
#: Folds fitted at a time: a level is a short job, which alone leaves most cores idle.
PARALLEL = 6


@dataclass(frozen=True)
class Settings:
    """loss: `logistic` for chances, `poisson` for counts (the offset is a log rate). patience: rounds without a better loss of the tail."""

    loss: str = "logistic"
    rounds: int = 60
    depth: int = 3
    step: float = 0.1
    l2: float = 5.0
    least_rows: int = 40
    bins: int = 32
    patience: int = 10
    row_share: float = 1.0
    feature_share: float = 1.0
    seed: int = 42


@dataclass
class Trees:
    """cuts[t][node] is (feature, bin): a row goes left when its bin is at most that. values[t] are those of the 2^depth leaves."""

    features: list[str]
    edges: list[list[float]]
    settings: Settings
    cuts: list[list[tuple[int, int]]] = field(default_factory=list)
    values: list[list[float]] = field(default_factory=list)

    def leaves(self, x: np.ndarray, cuts: list[tuple[int, int]], levels: int) -> np.ndarray:
        """The node that each row (bins by feature) has reached after so many levels, counted within the level."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for level in range(levels):
            f, b = np.array(cuts[(1 << level) - 1 : (2 << level) - 1], np.int64)[at].T
            at = 2 * at + (x[rows, f] > b)
        return at

    def margin(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(x))
        for cuts, values in zip(self.cuts[first:], self.values[first:]):
            out += np.array(values)[self.leaves(x, cuts, self.settings.depth)]
        return out

    def kept(self, rounds: int) -> Trees:
        return Trees(self.features, self.edges, self.settings, self.cuts[:rounds], self.values[:rounds])


def bin_of(value: Column, edges: list[float]) -> Column:
    """0 for a missing value, else 1 + the number of edges below the value: a native search by halves."""
    v = value.cast("double")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + 1)
        mid = (lo + hi) // 2
        return F.when(v <= F.lit(float(edges[mid])), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(search(0, len(edges))).cast("int")


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 distinct edges for each feature."""
    shares = [k / bins for k in range(1, bins)]
    found = df.select(*[F.col(f).cast("double") for f in features]).stat.approxQuantile(features, shares, 0.25 / bins)
    return [sorted(set(x)) for x in found]


def _binned(df: DataFrame, features: list[str], edges: list[list[float]]) -> Column:
    return F.array(*[bin_of(F.col(f), e) for f, e in zip(features, edges)])


def derivatives(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and curvature in units of 2^-UNIT_BITS, and the loss of each row."""
    if loss == "poisson":
        p = np.exp(np.clip(margin, -30, 30))
        g, h, cost = p - y, p, p - y * np.clip(margin, -30, 30)
    else:
        p = 1 / (1 + np.exp(-margin))
        g, h, cost = p - y, p * (1 - p), np.logaddexp(0, margin) - y * margin
    unit = float(1 << UNIT_BITS)
    return np.rint(g * unit).astype(np.int64), np.rint(h * unit).astype(np.int64), cost


def drawn(key: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Whether rows take part in a round, by a hash of their key."""
    x = key.astype(np.uint64) ^ np.uint64(((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1.0) * (2**64 - 2**11))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, width)


def level_sums(rows: DataFrame, trees: Trees, current: list[tuple[int, int]], level: int, done: int) -> DataFrame:
    """node, feature, bin, g, h, n of the core rows for one more level of the tree with these cuts; the row with feature -1 has the loss of the tail at g, in units.

    rows: x (bins), y, margin (offset and the first `done` trees), tail, key.
    """
    width, s, round_ = len(trees.features), trees.settings, len(trees.cuts)
    sent = rows.sparkSession.sparkContext.broadcast((trees, current))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, current = sent.value
        bins = max(len(e) for e in trees.edges) + 2
        size = (1 << level) * width * bins
        total, tail_loss, tail_rows = np.zeros((3, size), np.int64), 0, 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            y, margin, tail, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            g, h, cost = derivatives(s.loss, margin + trees.margin(x, done), y)
            tail_loss += int(np.rint(cost[tail] * (1 << UNIT_BITS)).astype(np.int64).sum())
            tail_rows += int(tail.sum())
            core = ~tail if s.row_share >= 1 else ~tail & drawn(key, round_, s.seed, s.row_share)
            x, g, h = x[core], g[core], h[core]
            slot = (trees.leaves(x, current, level)[:, None] * width + np.arange(width)) * bins + x
            for k, value in enumerate((g, h, np.ones(len(g), np.int64))):
                # halves of the whole numbers, as sums of doubles are exact below 2 ** 53 only
                for part, unit in ((value >> 20, 1 << 20), (value & ((1 << 20) - 1), 1)):
                    total[k] += np.bincount(slot.ravel(), np.repeat(part, width), size).astype(np.int64) * unit
        used = np.flatnonzero(total[2])
        node, feature, bin_ = used // (width * bins), used // bins % width, used % bins
        cells = [np.append(c, extra) for c, extra in ((node, 0), (feature, -1), (bin_, 0), (total[0][used], tail_loss), (total[1][used], 0), (total[2][used], tail_rows))]
        yield pa.record_batch([pa.array(c.astype(t)) for c, t in zip(cells, (np.int32, np.int32, np.int32, np.int64, np.int64, np.int64))], ["node", "feature", "bin", "g", "h", "n"])

    each = rows.select("x", "y", "margin", "tail", "key").mapInArrow(run, "node int, feature int, bin int, g long, h long, n long")
    return each.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def best_cuts(sums: list[tuple[int, int, int, int, int, int]], nodes: int, s: Settings, allowed: set[int]) -> list[tuple[int, int]]:
    """For each node the cut of the largest gain, the first of equals; (0, a bin beyond all) where no cut gains, so all rows go left."""
    cells: dict[tuple[int, int], list] = {}
    for node, feature, bin_, g, h, n in sorted(sums):
        cells.setdefault((node, feature), []).append((bin_, g, h, n))
    unit, out = float(1 << UNIT_BITS), []
    worth = lambda g, h: (g / unit) ** 2 / (h / unit + s.l2)
    for node in range(nodes):
        best, cut = 1e-12, (0, 1 << 20)
        for (at, feature), cs in sorted(cells.items()):
            if at != node or feature not in allowed:
                continue
            whole = [sum(c[k] for c in cs) for k in (1, 2, 3)]
            g = h = n = 0
            for bin_, cg, ch, cn in cs[:-1]:
                g, h, n = g + cg, h + ch, n + cn
                if n < s.least_rows or whole[2] - n < s.least_rows:
                    continue
                gain = worth(g, h) + worth(whole[0] - g, whole[1] - h) - worth(whole[0], whole[1])
                if gain > best + 1e-12:
                    best, cut = gain, (feature, bin_)
        out.append(cut)
    return out


def leaf_values(sums: list[tuple[int, int, int, int, int, int]], cuts: list[tuple[int, int]], s: Settings) -> list[float]:
    """-step * G / (H + l2) of each leaf: the sums of the last level on both sides of its cuts."""
    unit, out = float(1 << UNIT_BITS), []
    for node, (feature, bin_) in enumerate(cuts):
        own = [r for r in sums if r[:2] == (node, feature)]
        for side in ([r for r in own if r[2] <= bin_], [r for r in own if r[2] > bin_]):
            g, h = sum(r[3] for r in side), sum(r[4] for r in side)
            out.append(-s.step * (g / unit) / (h / unit + s.l2) if side else 0.0)
    return out


def allowed_features(s: Settings, round_: int, width: int) -> set[int]:
    """The features of a round; at least one."""
    if s.feature_share >= 1:
        return set(range(width))
    order = np.random.default_rng([s.seed, round_]).permutation(width)
    return set(order[: max(1, round(s.feature_share * width))].tolist())


def fit(train: DataFrame, features: list[str], label: str, offset: Column, date: str, settings: Settings = Settings(), key: Column | None = None, edges: list[list[float]] | None = None) -> Trees:
    """Trees on what the offset leaves unexplained, stopped early on the last days of train (which they never learn from).

    key: a long that tells rows apart, for row_share. Rows without a label are left out.
    """
    train = train.filter(F.col(label).isNotNull())
    edges = edges or quantile_edges(train, features, settings.bins)
    ready = core_and_tail(train, date).select(
        _binned(train, features, edges).alias("x"), F.col(label).cast("double").alias("y"), offset.cast("double").alias("margin"), (F.col("part") == "tail").alias("tail"), (F.lit(0) if key is None else key).cast("long").alias("key")
    )
    rows, done = written(ready, "boosting-rows"), 0
    trees, best, best_at = Trees(list(features), edges, settings), float("inf"), 0
    for round_ in range(settings.rounds + 1):
        cuts: list[tuple[int, int]] = []
        for level in range(settings.depth):
            # nodes * features * bins rows
            sums = [tuple(r) for r in level_sums(rows, trees, cuts, level, done).collect()]
            if level == 0:
                _, _, _, loss, _, n = next(r for r in sums if r[1] == -1)
                if n and loss < best - 0.5:
                    best, best_at = loss, round_
                if round_ == settings.rounds or n and round_ - best_at >= settings.patience:
                    return trees.kept(best_at if n else round_)
            sums = [r for r in sums if r[1] >= 0]
            cuts += best_cuts(sums, 1 << level, settings, allowed_features(settings, round_, len(features)))
        trees.cuts.append(cuts)
        trees.values.append(leaf_values(sums, cuts[-(1 << settings.depth - 1) :], settings))
        if len(trees.cuts) - done >= REWRITE:
            rows = written(_moved(rows, trees, done), "boosting-rows")
            done = len(trees.cuts)
    return trees


def _moved(rows: DataFrame, trees: Trees, done: int) -> DataFrame:
    """rows with the trees after the first `done` added to their margins."""
    width = len(trees.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column(2).to_numpy() + trees.margin(_matrix(batch.column(0), width), done)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(margin), batch.column(3), batch.column(4)], ["x", "y", "margin", "tail", "key"])

    return rows.select("x", "y", "margin", "tail", "key").mapInArrow(run, rows.schema)


def adjustment(df: DataFrame, trees: Trees, name: str = "adjustment") -> DataFrame:
    """df with the sum of the trees, without the offset."""
    missing = [f for f in trees.features if f not in df.columns]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    width = len(trees.features)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(trees.margin(np.stack(x.to_numpy()) if len(x) else np.zeros((0, width), np.int64)))

    return df.withColumn(name, run(_binned(df, trees.features, trees.edges)))


@dataclass
class Scorer:
    """With a price: trees on the log-odds of the market; without: trees that don't see the market. Both with their own temperature."""

    features: list[str]
    with_market: Trees
    temperature: tuple[float, float]
    blind: Trees
    blind_temperature: tuple[float, float]
    rows: int
    trained_through: str


MARKET = ("market_prob", "market_available")


def _sigmoid(slope: float, intercept: float, logit: Column) -> Column:
    return 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * logit)))


def _side_by_side(spark: SparkSession, steps: list[Callable]) -> list:
    """The results of steps whose jobs run at the same time, in their order."""
    with ThreadPool(max(1, min(PARALLEL, len(steps)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda step: step()), steps, 1)


def fit_scorer(train: DataFrame, features: list[str], label: str, date: str, settings: Settings = Settings(), least_rows: int = 1, key: Column | None = None) -> Scorer:
    """Both models, each split into core and tail on its own rows: the first on rows with a price, the second on all.

    features may name the columns of MARKET (a fair price, and whether there is one), which the second model doesn't get.
    """
    train = train.filter(F.col(label).isNotNull())
    size = train.agg(F.count(F.lit(1)).alias("n"), F.max(date).cast("string").alias("through")).first()
    if size["n"] < least_rows:
        raise ValueError(f"{size['n']} labelled rows are not enough to train on")
    price, available = F.col(MARKET[0]), F.coalesce(F.col(MARKET[1]).cast("boolean"), F.lit(False))
    offset = market_logit(price, available)
    blind_features = [f for f in features if f not in MARKET]
    priced = train.filter(available)

    def heat(df: DataFrame, trees: Trees, offset: Column) -> tuple[float, float]:
        tail = adjustment(core_and_tail(df, date).filter("part = 'tail'"), trees, "__a")
        return temperature(written(tail.select((offset + F.col("__a")).alias("__margin"), label), "boosting-tail"), "__margin", label)

    def model(part: DataFrame, names: list[str], offset: Column) -> tuple[Trees, tuple[float, float]]:
        trees = fit(part, names, label, offset, date, settings, key)
        return trees, heat(part, trees, offset)

    (with_market, hot), (blind, blind_hot) = _side_by_side(train.sparkSession, [lambda: model(priced, features, offset), lambda: model(train, blind_features, F.lit(0.0))])
    return Scorer(list(features), with_market, hot, blind, blind_hot, size["n"], size["through"])


def score(df: DataFrame, scorer: Scorer, features: list[str] | None = None, name: str = "p") -> DataFrame:
    """df with the chance by the model that its row's regime asks for. Other features, or features in another order, than those of training are an error."""
    if features is not None and list(features) != scorer.features:
        raise ValueError("these are not the features the model was trained on, in their order")
    available = F.coalesce(F.col(MARKET[1]).cast("boolean"), F.lit(False))
    offset = market_logit(F.col(MARKET[0]), available)
    out = adjustment(adjustment(df, scorer.with_market, "__m"), scorer.blind, "__b")
    p = F.when(available, _sigmoid(*scorer.temperature, offset + F.col("__m"))).otherwise(_sigmoid(*scorer.blind_temperature, F.col("__b")))
    return out.withColumn(name, p).drop("__m", "__b")


def walk_forward(df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), purge_days: int = 7, key: Column | None = None) -> DataFrame:
    """df's predictable seasons with fold and p, each by a scorer of the seasons before."""
    df, out = written(df, "boosting-input"), None  # every fold reads it a dozen times

    def one(fold: int, train: DataFrame, validate: DataFrame) -> DataFrame:
        return score(validate, fit_scorer(train, features, label, "date", settings, key=key)).withColumn("fold", F.lit(fold))

    for each in _side_by_side(df.sparkSession, [partial(one, *f) for f in _each_fold(df, purge_days)]):
        out = each if out is None else out.unionByName(each)
    return out if out is not None else df.limit(0).withColumns({"p": F.lit(0.0), "fold": F.lit(0)})


def cross_fitted(df: DataFrame, groups: str, features: list[str], label: str, date: str, folds: int = 5, settings: Settings = Settings(), name: str = "p") -> DataFrame:
    """df with chances from models of the other groups: a first season has none before it. Groups (games) go to folds by a hash, so none is split."""
    dealt, out = written(df.withColumn("__fold", F.pmod(F.xxhash64(groups), F.lit(folds))), "boosting-input"), None
    for k in range(folds):
        trees = fit(dealt.filter(F.col("__fold") != k), features, label, F.lit(0.0), date, settings)
        one = adjustment(dealt.filter(F.col("__fold") == k), trees, "__a")
        out = one if out is None else out.unionByName(one)
    return out.withColumn(name, _sigmoid(1.0, 0.0, F.col("__a"))).drop("__a", "__fold")


def save(scorer: Scorer, spark: SparkSession, path: str) -> None:
    """The scorer as one JSON text, by Spark's writer, so any file system will do. An existing one is never replaced."""
    spark.createDataFrame([(json.dumps(asdict(scorer)),)], "value string").coalesce(1).write.mode("error").text(path)


def load(spark: SparkSession, path: str) -> Scorer:
    raw = json.loads(spark.read.text(path).first()["value"])

    def trees(x: dict) -> Trees:
        return Trees(x["features"], x["edges"], Settings(**x["settings"]), [[tuple(c) for c in t] for t in x["cuts"]], x["values"])

    return Scorer(raw["features"], trees(raw["with_market"]), tuple(raw["temperature"]), trees(raw["blind"]), tuple(raw["blind_temperature"]), raw["rows"], raw["trained_through"])
