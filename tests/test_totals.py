"""Attacks, goal rates and totals against prices on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretime.plans import boosting, totals


def test_variants_of_features():
    names = totals.attack_names([5])
    assert len(names) == len(set(names)) == 6 + 5 + 2 + 3 + 13
    assert totals.variant(names, ("role_x",)) == names
    assert totals.variant(names, ("role_x",), role=True) == [*names, "role_x"]
    assert not any(n.startswith("goalie_") for n in totals.variant(names, ("role_x",), goalie=False, role=True))


def test_goal_rates_take_out_the_level_of_the_season(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(1500):
        season, x, env = 2021 + i // 500, float(rng.random()), 6.0
        rows.append((season, dt.date(season, 1, 1) + dt.timedelta(days=(i % 500) // 4), i, x, env, int(rng.poisson(env / 2 * (1.5 if x > 0.5 else 0.7)))))
    df = spark.createDataFrame(rows, "season int, date date, game_id int, x double, env double, goals int")
    train, score = df.filter("season < 2023"), df.filter("season = 2023")
    out = totals.goal_rates(train, score, ["x"], "env", boosting.Settings(loss="poisson", rounds=12, depth=1, step=0.3, least_rows=30)).cache()
    by = {r["hi"]: r["m"] for r in out.groupBy((F.col("x") > 0.5).alias("hi")).agg(F.avg("rate").alias("m")).collect()}
    assert by[True] > 1.6 * by[False] and out.filter("rate < 0.4 OR rate > 8").count() == 0
    # outcomes of the scored season change nothing
    again = totals.goal_rates(train, score.withColumn("goals", F.lit(0)), ["x"], "env", boosting.Settings(loss="poisson", rounds=12, depth=1, step=0.3, least_rows=30))
    assert {r["game_id"]: r["rate"] for r in out.collect()} == {r["game_id"]: r["rate"] for r in again.collect()}


def test_closing_totals_need_both_sides_at_one_line(spark):
    row = lambda at, side, point, price=-110, start=10, book="x": (1, book, side, price, point, at, start)
    rows = [row(1, "over", 6.0), row(1, "under", 6.0), row(2, "over", 6.5, -105), row(2, "under", 6.5, -115), row(3, "over", 5.5), row(3, "under", 6.0), row(4, "over", 7.0), row(10, "over", 8.0), row(10, "under", 8.0), row(5, "over", 5.0, None, book="y"), row(5, "under", 5.0, -110, book="y")]
    got = totals.closing_totals(spark.createDataFrame(rows, "game_id int, book string, side string, price int, point double, at int, start int"))
    assert [tuple(r) for r in got.collect()] == [(1, "x", 6.5, -105, -115)]


def test_the_main_line_is_the_most_quoted_and_the_most_balanced(spark):
    rows = [(1, 5.5, -110, -110), (1, 6.5, -150, 130), (1, 6.5, -150, 130), (2, 5.5, -150, 130), (2, 6.0, -112, -108), (2, 7.0, None, -110)]
    got = {r["game_id"]: tuple(r)[1:] for r in totals.market_overs(spark.createDataFrame(rows, "game_id int, line double, over_price int, under_price int")).collect()}
    assert got[1][0] == 6.5 and got[1][2] == 2 and got[2][0] == 6.0 and got[2][2] == 1


def test_the_check_of_totals_needs_games(spark):
    df = spark.createDataFrame([(6, 5.5, 0.9, 0.0, 0.5)] * 5 + [(6, 6.0, 0.5, 0.2, 0.5)], "total int, line double, p_over double, p_push double, fair_over double")
    r = totals.totals_check(df).first()
    assert r["n"] == 5 and r["beats_market"] is None and r["model_loss"] == pytest.approx(-np.log(0.9))
    assert totals.totals_check(df, 5).first()["beats_market"]
    assert totals.totals_check(df.limit(0)).first()["n"] == 0


def test_closes_need_both_sides(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m, tzinfo=dt.timezone.utc)
    rows = [(1, 9, "a", 0.5, 0.52, t(0), t(30)), (1, 9, "b", 0.47, 0.5, t(10), t(30)), (2, 9, "a", 0.0, 0.4, t(0), t(30)), (2, 9, "b", 0.5, 0.6, t(0), t(30)), (3, 9, "a", 0.5, 0.6, t(0), t(30)), (4, 8, "a", None, None, t(0), t(30))]
    got = {r["season"]: tuple(r)[1:] for r in totals.closes_by_season(spark.createDataFrame(rows, "game_id int, season int, side string, bid double, ask double, at timestamp, start timestamp")).collect()}
    assert got == {9: (3, 1, 0.025, 0.02, 25.0), 8: (1, 0, None, None, None)}
