"""Slips as typed in, bets of a strategy, moves of free prices."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foretime.plans import checker


def test_legs_are_parsed_or_told_what_is_wrong(spark):
    cases = {
        "bos@tor ml away -125": (None, "BOS", "TOR", "ml", "AWAY", None, -125), " BOS@TOR, total over 6.5 +105 ": (None, "BOS", "TOR", "total", "OVER", 6.5, 105), "BOSTOR ml away -125": ("teams",), "A@B pl away -125": ("market",), "A@B ml away": ("length",), "A@B total over 6.5": ("length",),
        "A@B ml left 100": ("side",), "A@B ml home x": ("number",), "A@B total over x -110": ("number",), "": ("teams",), None: ("teams",), "A@B": ("market",),
    }
    df = spark.createDataFrame([(k, s) for k, s in enumerate(cases)], "k int, spec string")
    got = {r["k"]: r for r in checker.parsed_legs(df).collect()}
    for k, want in enumerate(cases.values()):
        row = tuple(got[k][c] for c in ("fault", "away", "home", "market", "side", "line", "price"))
        assert row == (want if len(want) > 1 else (want[0], *[None] * 6)), list(cases)[k]


def test_games_by_day_or_the_next_one(spark):
    day = lambda d: dt.date(2024, 1, d)
    games = spark.createDataFrame([(1, "T", "B", day(3)), (2, "T", "B", day(8)), (3, "T", "B", day(20))], "game_id int, home string, away string, date date")
    legs = spark.createDataFrame([(1, "T", "B", None), (2, "T", "B", day(3)), (3, "T", "B", day(4)), (4, "B", "T", None)], "k int, home string, away string, on date")
    assert {r["k"]: r["game_id"] for r in checker.with_games(legs, games, "2024-01-05").collect()} == {1: 2, 2: 1, 3: None, 4: None}


def test_verdicts_of_legs_and_slips(spark):
    leg = lambda s, g, m, price, p, push=0.0, offered=None: (s, g, m, price, p, push, offered)
    rows = [leg(1, 1, "ml", 100, 0.56), leg(1, 2, "ml", 100, 0.54), leg(2, 1, "ml", 100, 0.6), leg(2, 1, "total", 100, 0.6), leg(3, 1, "ml", 100, None), leg(4, 1, "ml", -110, 0.51), leg(5, 1, "total", 100, 0.5, 0.1), leg(6, 1, "ml", 100, 0.52), leg(7, 1, "ml", 100, 0.56, 0.0, 120), leg(8, 1, "ml", 100, 0.0), leg(8, 2, "ml", 100, 0.9)]
    legs = checker.judged_legs(spark.createDataFrame(rows, "slip_id int, game_id int, market string, price int, p_win double, p_push double, offered int")).cache()
    told = {(r["slip_id"], r["game_id"], r["market"]): (r["verdict"], r["ev"]) for r in legs.collect()}
    assert told[(1, 1, "ml")][0] == "BET" and told[(4, 1, "ml")][0] == "PASS" and told[(6, 1, "ml")][0] == "THIN" and told[(3, 1, "ml")] == ("NO-MODEL", None)
    assert told[(5, 1, "total")][0] == "THIN" and told[(5, 1, "total")][1] == pytest.approx(0.5 - 0.4)
    got = {r["slip_id"]: r for r in checker.judged_slips(legs).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "BET", 2: "WITHHELD", 3: "NO-MODEL", 4: "PASS", 5: "THIN", 6: "THIN", 7: "BET", 8: "PASS"}
    assert got[1]["ev"] == pytest.approx(4 * 0.56 * 0.54 - 1) and got[1]["stake"] == pytest.approx(min(0.02, 0.25 * max(0, (3 * 0.3024 - 0.6976) / 3))) and got[2]["ev"] is None
    assert got[7]["ev"] == pytest.approx(2.2 * 0.56 - 1) and got[8]["p_all"] == 0 and got[5]["ev"] == pytest.approx(0.5 * 2 + 0.1 - 1)


def test_bets_pay_fees_and_are_summed_by_edge(spark):
    row = lambda g, p, fair, home, away, hb, won: (g, dt.date(2024, 1, 1), p, fair, home, away, hb, "x", 0.5, won)
    games = spark.createDataFrame([row(1, 0.6, 0.5, 110, -130, "x", True), row(2, 0.6, 0.5, 110, -130, "k", False), row(3, 0.4, 0.5, -130, 110, "x", False), row(4, 0.51, 0.5, 110, -130, "x", True), row(5, None, 0.5, 110, -130, "x", True)], "game_id int, date date, p double, fair double, home int, away int, home_book string, away_book string, fair_close double, home_win boolean")
    bets = checker.made_bets(games, {"k": 0.07}).cache()
    got = {r["game_id"]: r for r in bets.collect()}
    q = 100 / 210
    assert set(got) == {1, 2, 3} and got[1]["flat_pnl"] == pytest.approx(1.1) and got[2]["flat_pnl"] == -1 and got[2]["decimal"] == pytest.approx(1 / (q + 0.07 * q * (1 - q))) and got[3]["side"] == "AWAY" and got[3]["won"]
    summary = {r["bucket"]: r for r in checker.bet_summary(bets).collect()}
    assert summary[None]["bets"] == 3 and summary[None]["hit_rate"] == pytest.approx(2 / 3) and set(summary) == {None, ">=0.09"}


def test_moves_that_cannot_be_ruled_out(spark):
    paid = spark.createDataFrame([(g, 10_000) for g in (1, 2, 3, 4)] + [(1, 5_000)], "game_id int, at long")
    row = lambda g, at, home, away, v="a": (g, v, at, home, away)
    feed = spark.createDataFrame([row(1, 9_000, -110, -110), row(1, 20_000, -130, 110), row(1, 15_000, 500, -700), row(2, 9_000, -110, -110), row(3, 20_000, -110, -110), row(1, 9_500, -110, -110, "b"), row(1, 21_000, -112, -108, "b")], "game_id int, venue string, at long, home int, away int")
    got = {r["game_id"]: (r["verdict"], r["venues"]) for r in checker.feed_moves(paid, feed).collect()}
    assert got == {1: ("known", 2), 2: ("unknown_now", 0), 3: ("unknown_before", 0), 4: ("unknown_now", 0)}
    moves = checker.feed_moves(paid, feed)
    ids = lambda *g: spark.createDataFrame([(x, dt.date(2024, 1, 1)) for x in g], "game_id int, date date")
    plan = {r["game_id"]: r["may_pick"] for r in checker.rescore_plan(ids(1, 1, 2, 3, 9), ids(1, 2, 3, 4), ids(3), moves, 0.5).collect()}
    assert plan == {1: True, 2: False}
    assert {r["game_id"]: r["may_pick"] for r in checker.rescore_plan(ids(1), ids(1), ids(), moves, 0.01).collect()} == {1: False}
    assert checker.feed_moves(paid, feed, F.lit(30_000)).filter("game_id = 1").first()["verdict"] == "unknown_now"


def test_voided_picks_open_their_game(spark):
    picks = spark.createDataFrame([(1, "ml", None), (2, "ml", True), (3, "total", False), (1, "ml", True)], "game_id int, market string, voided boolean")
    assert [r["game_id"] for r in checker.frozen_games(picks).collect()] == [1]
