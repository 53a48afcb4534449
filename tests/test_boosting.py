"""Boosted trees against a plain booster over all rows, the two-model scorer, saved models."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretime.operators import stats
from foretime.plans import boosting
from foretime.plans.boosting import Settings

UNIT = float(1 << boosting.UNIT_BITS)


def made(n, seed, counts=False):
    """The truth is the offset and 1.5 more where x is over 0.5; some values are missing."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        x, market = rnd.random(), rnd.gauss(0, 0.8)
        m = market + (1.5 if x > 0.5 else -0.5)
        y = int(np.random.default_rng([seed, i]).poisson(math.exp(m / 2))) if counts else int(rnd.random() < 1 / (1 + math.exp(-m)))
        day = datetime.date(2000 + i * 3 // n, 1, 1) + datetime.timedelta(days=i * 3 % n * 300 // n)
        out.append((2000 + i * 3 // n, day, x if rnd.random() < 0.9 else None, rnd.random(), market, y, i))
    return out


SCHEMA = "season int, date date, x double, noise double, market double, y int, id long"


def plain(rows, edges, s):
    """Trees by loops over all rows: gradients anew each round, every cut tried."""
    days = sorted(r[1] for r in rows)
    total, cum, tail_days = len(rows), 0, set()
    for d in sorted(set(days)):
        cum += days.count(d)
        if cum > (1 - 0.15) * total:
            tail_days.add(d)
    x = [[0 if v is None else 1 + sum(v > e for e in es) for v, es in zip(r[2:4], edges)] for r in rows]
    margin, trees, losses = [r[4] for r in rows], [], []
    tail = [r[1] in tail_days for r in rows]
    for round_ in range(s.rounds + 1):
        g, h, cost = boosting.derivatives(s.loss, np.array(margin), np.array([float(r[5]) for r in rows]))
        losses.append(sum(int(round(c * UNIT)) for c, t in zip(cost, tail) if t))
        best = min(range(len(losses)), key=lambda k: losses[k])
        if round_ == s.rounds or round_ - best >= s.patience:
            return trees[:best], losses
        core = [k for k in range(len(rows)) if not tail[k]]
        groups, cuts = [core], []
        for _ in range(s.depth):
            nxt = []
            for own in groups:
                worth = lambda ks: (sum(int(g[k]) for k in ks) / UNIT) ** 2 / (sum(int(h[k]) for k in ks) / UNIT + s.l2)
                found, cut = 1e-12, (0, 1 << 20)
                for f in range(2):
                    for b in sorted({x[k][f] for k in own})[:-1]:
                        left, right = [k for k in own if x[k][f] <= b], [k for k in own if x[k][f] > b]
                        if min(len(left), len(right)) >= s.least_rows and (gain := worth(left) + worth(right) - worth(own)) > found + 1e-12:
                            found, cut = gain, (f, b)
                cuts.append(cut)
                nxt += [[k for k in own if x[k][cut[0]] <= cut[1]], [k for k in own if x[k][cut[0]] > cut[1]]]
            groups = nxt
        values = [-s.step * (sum(int(g[k]) for k in ks) / UNIT) / (sum(int(h[k]) for k in ks) / UNIT + s.l2) if ks else 0.0 for ks in groups]
        trees.append((cuts, values))
        for k in range(len(rows)):
            at = 0
            for level in range(s.depth):
                f, b = cuts[(1 << level) - 1 + at]
                at = 2 * at + (x[k][f] > b)
            margin[k] += values[at]


@pytest.mark.parametrize("loss", ["logistic", "poisson"])
def test_trees_equal_plain_boosting(spark, loss):
    rows = made(2000, 4, loss == "poisson")
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    edges = [[k / 8 for k in range(1, 8)], [0.25, 0.5, 0.75]]
    s = Settings(loss=loss, rounds=10, depth=2, step=0.3, least_rows=60, patience=3)
    got = boosting.fit(df, ["x", "noise"], "y", F.col("market"), "date", s, edges=edges)
    want, _ = plain(rows, edges, s)
    assert got.cuts == [t[0] for t in want]
    assert np.allclose(got.values, [t[1] for t in want], rtol=0, atol=1e-12)
    assert got.cuts[0][0] == (0, 4)  # the step at 0.5


def test_partitions_do_not_change_the_trees(spark):
    df = spark.createDataFrame(made(900, 9), SCHEMA)
    s = Settings(rounds=4, depth=2, row_share=0.8, feature_share=0.5)
    one, many = (boosting.fit(df.repartition(n), ["x", "noise"], "y", F.col("market"), "date", s, F.col("id"), [[0.3, 0.5, 0.7], [0.5]]) for n in (1, 7))
    assert one.cuts == many.cuts and one.values == many.values


def test_bins_and_missing_values(spark):
    edges = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (1.0,), (1.5,), (3.0,), (9.0,)], "v double")
    assert [r["b"] for r in df.select(boosting.bin_of(F.col("v"), edges).alias("b")).collect()] == [0, 0, 1, 1, 2, 3, 4]
    assert df.select(boosting.bin_of(F.col("v"), []).alias("b")).distinct().count() == 2


@pytest.fixture(scope="module")
def priced(spark):
    df = spark.createDataFrame(made(1500, 2), SCHEMA)
    return df.withColumns({"market_available": F.col("id") % 3 != 0, "market_prob": F.when(F.col("id") % 3 != 0, 1 / (1 + F.exp(-F.col("market"))))}).cache()


FEATURES = ["x", "noise", "market_prob", "market_available"]


def test_each_row_is_scored_by_its_regime(spark, priced, tmp_path):
    train, new = priced.filter("season < 2002"), priced.filter("season = 2002")
    scorer = boosting.fit_scorer(train, FEATURES, "y", "date", Settings(rounds=12, least_rows=20))
    assert scorer.blind.features == ["x", "noise"] and scorer.with_market.features == FEATURES
    out = boosting.score(new, scorer, FEATURES)
    blind = boosting.score(new.withColumns({"market_available": F.lit(False), "market_prob": F.lit(None).cast("double")}), scorer).select("id", F.col("p").alias("q"))
    both = out.join(blind, "id")
    # a row without a price gets the same chance as if no row had one; the price moves the others
    assert both.filter(~F.col("market_available") & (F.abs(F.col("p") - F.col("q")) > 1e-12)).count() == 0
    assert both.filter(F.col("market_available") & (F.abs(F.col("p") - F.col("q")) > 0.01)).count() > 100
    loss = lambda p: F.avg(stats.log_loss(F.col("y").cast("double"), p))
    r = out.filter("market_available").agg(loss(F.col("p")).alias("p"), loss(F.col("market_prob")).alias("market")).first()
    assert r["p"] < r["market"] - 0.05
    # saved, and read by another session
    path = f"file://{tmp_path}/scorer"
    boosting.save(scorer, spark, path)
    again = boosting.score(new, boosting.load(spark.newSession(), path), FEATURES)
    assert {r["id"]: r["p"] for r in again.collect()} == {r["id"]: r["p"] for r in out.collect()}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        boosting.save(scorer, spark, path)


def test_other_features_or_too_few_rows_are_an_error(priced):
    scorer = boosting.fit_scorer(priced, FEATURES, "y", "date", Settings(rounds=2, least_rows=20))
    with pytest.raises(ValueError, match="not the features"):
        boosting.score(priced, scorer, FEATURES[::-1])
    with pytest.raises(ValueError, match="missing: \\['noise'\\]"):
        boosting.score(priced.drop("noise"), scorer)
    with pytest.raises(ValueError, match="not enough"):
        boosting.fit_scorer(priced.limit(10), FEATURES, "y", "date", least_rows=500)


def test_walk_forward_never_sees_the_own_season(priced):
    s = Settings(rounds=3, least_rows=20)
    out = {r["id"]: r["p"] for r in boosting.walk_forward(priced.filter("season < 2002"), FEATURES, "y", s).collect()}
    turned = boosting.walk_forward(priced.withColumn("y", F.when(F.col("season") >= 2001, 1 - F.col("y")).otherwise(F.col("y"))).filter("season < 2002"), FEATURES, "y", s)
    assert out == {r["id"]: r["p"] for r in turned.collect()} and len(out) == 500


def test_cross_fitting_leaves_the_own_group_out(spark, priced):
    df = priced.filter("season = 2000").withColumn("game", F.col("id") % 40)
    s, fold = Settings(rounds=2, least_rows=10), F.pmod(F.xxhash64("game"), F.lit(3))
    a = boosting.cross_fitted(df, "game", ["x"], "y", "date", 3, s)
    b = boosting.cross_fitted(df.withColumn("y", F.when(fold == 1, 0).otherwise(F.col("y"))), "game", ["x"], "y", "date", 3, s)
    p, q = ({r["id"]: r["p"] for r in x.filter(fold == 1).collect()} for x in (a, b))
    assert p and p == q and a.count() == df.count()


def test_walk_forward_makes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(made(900, 3), SCHEMA).withColumns({"market_prob": F.lit(0.5), "market_available": F.col("id") % 2 == 0}).coalesce(2)
    df = df.mapInArrow(counted, df.schema)
    out = boosting.walk_forward(df, ["x", "noise", *boosting.MARKET], "y", Settings(rounds=1, depth=1, least_rows=20)).collect()
    assert {r["fold"] for r in out} == {2001, 2002} and seen.value == 900
