"""Counts of players: dispersion, walk-forward booster, gates, outcomes and the check against prices."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretime.plans import boosting, counts


def nb_nll(y, mu, a):
    if a <= 1e-10:
        return mu - y * math.log(mu) + math.lgamma(y + 1)
    r = 1 / a
    return -(math.lgamma(y + r) - math.lgamma(r) - math.lgamma(y + 1) + r * math.log(r / (r + mu)) + y * math.log(mu / (r + mu)))


def test_count_nll_equals_the_formula(spark):
    rows = [(y, mu, a) for y in (0, 1, 2, 7, 15) for mu in (0.2, 2.5) for a in (0.0, 0.05, 0.8)]
    got = spark.createDataFrame(rows, "y int, mu double, a double").select("y", "mu", "a", counts.count_nll(F.col("y"), F.col("mu"), F.col("a")).alias("nll")).collect()
    assert all(r["nll"] == pytest.approx(nb_nll(r["y"], r["mu"], r["a"]), abs=1e-9) for r in got)


def test_dispersion_is_found(spark):
    rng = np.random.default_rng(4)
    mu = rng.uniform(1, 4, 4000)
    wide = rng.poisson(mu * rng.gamma(1 / 0.4, 0.4, 4000))
    df = spark.createDataFrame([(int(y), int(z), float(m)) for y, z, m in zip(wide, rng.poisson(mu), mu)], "y int, z int, mu double").coalesce(4)
    a = counts.fit_alpha(df, "y", "mu")
    best = min((sum(nb_nll(int(y), float(m), g) for y, m in zip(wide, mu)), g) for g in np.linspace(a - 0.02, a + 0.02, 21))[1]
    assert 0.3 < a < 0.5 and abs(a - best) < 0.0021
    assert counts.fit_alpha(df, "z", "mu") < 0.05
    with pytest.raises(ValueError, match="positive"):
        counts.exposure(F.lit(1.0), F.lit(1.0), F.lit(1.0), 0.0)


def test_walk_forward_counts_learn_from_earlier_seasons(spark):
    rng, rows = np.random.default_rng(7), []
    for i in range(1800):
        season, x = 2021 + i // 600, float(rng.random())
        day = dt.date(season, 1, 1) + dt.timedelta(days=(i % 600) // 3)
        base = float(rng.uniform(1, 3))
        rows.append((season, day, i, x, base * 2, 1800.0, 6.0, int(rng.poisson(base * (1.6 if x > 0.5 else 0.7))), 1800.0))
    df = spark.createDataFrame(rows, "season int, date date, id int, x double, shrunk_sog60 double, exp_toi double, league_pos_sog60 double, sog int, toi double").cache()
    s = boosting.Settings(loss="poisson", rounds=15, depth=2, step=0.3, least_rows=30)
    out = counts.walk_forward_counts(df, ["x"], s).cache()
    assert {r["fold"] for r in out.select("fold").distinct().collect()} == {2022, 2023} and out.count() == 1200
    scores = counts.score_counts(out, "fold", {"M": ("mu", F.col("alpha")), "B": ("base", 0.0)}, against="B")
    r = {x["fold"]: x for x in scores.collect()}
    assert set(r) == {"2022", "2023", counts.POOLED} and all(x["diff_M"] < -0.05 for x in r.values())
    told = counts.gate(scores, "fold", "M", "B").first()
    assert told["better"] and told["folds_won"] == 2 and not told["passed"]  # two folds of the four that it asks for
    # outcomes of the last season change no prediction of the first
    later = counts.walk_forward_counts(df.withColumn("sog", F.when(F.col("season") == 2023, 0).otherwise(F.col("sog"))), ["x"], s)
    pick = lambda d: {x["id"]: x["mu_drift"] for x in d.filter("fold = 2022").collect()}
    assert pick(out) == pick(later)


def test_adoption_compares_with_the_present_one():
    better = {("P1", "P0"): (-0.01, 0.002, 4), ("P2", "P1"): (-0.01, 0.02, 5), ("P3", "P1"): (-0.01, 0.001, 3), ("P4", "P1"): (-0.01, 0.001, 5)}
    assert counts.adopted("P0", ["P1", "P2", "P3", "P4", "P5"], better, dict.fromkeys(("P1", "P2", "P3", "P4"), True)) == [("P1", "P0", True), ("P2", "P1", False), ("P3", "P1", False), ("P4", "P1", True)]
    assert counts.adopted("P0", ["P1"], better, {"P1": False}) == [("P1", "P0", False)]


def test_outcomes_must_agree(spark):
    props = spark.createDataFrame([(1, 5, 2.5, 3), (1, 6, 2.0, 2), (2, 5, 1.5, 0)], "game_id int, player_id int, line double, sog int")
    played = spark.createDataFrame([(1, 5, 3), (1, 6, 2), (2, 5, 0)], "game_id int, player_id int, shots int")
    keys = ["game_id", "player_id"]
    assert sorted((r["player_id"], r["over_hit"]) for r in counts.with_outcomes(props, played, keys).collect()) == [(5, 0.0), (5, 1.0)]  # the push is out
    with pytest.raises(Exception, match="no outcome"):
        counts.with_outcomes(props, played.filter("game_id = 1"), keys).collect()
    with pytest.raises(Exception, match="disagrees"):
        counts.with_outcomes(props, played.withColumn("shots", F.col("shots") + 1), keys).collect()


def test_the_check_needs_every_large_venue(spark):
    rnd = random.Random(2)
    rows = [(b, g, p if b != "bad" else 0.5, 0.5, float(rnd.random() < p)) for b in ("good", "bad", "few") for g in range(40 if b == "few" else 600) for p in (0.2, 0.8)]
    out = counts.against_prices(spark.createDataFrame(rows, "book string, game_id int, p_model double, p_mkt double, over_hit double"))
    got = {r["book"]: r["beats_market"] for r in out.collect()}
    assert got == {"good": True, "bad": False, "few": False, counts.POOLED: True}
    assert tuple(counts.check_passed(out).first()) == (True, 1, False)
    assert tuple(counts.check_passed(out.filter("book <> 'bad'")).first()) == (True, 0, True)
    one = counts.against_prices(spark.createDataFrame(rows[:1], "book string, game_id int, p_model double, p_mkt double, over_hit double")).first()
    assert one["se"] is None and not one["beats_market"]
