"""Feed readers on bodies made by hand, with what feeds get wrong; roles of goalies."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from foretime.functions import text
from foretime.plans import readers, roles
from foretime.sources import feeds, tables

DAY = dt.date(2024, 1, 1)


def bodies(spark, rows, schema="game_id int, body string"):
    return spark.createDataFrame(rows, schema)


def test_feed_prices(spark):
    cases = {"-125": -125, "+104": 104, "105.0": 105, "2.12": 112, "1.72": -139, "2": 100, "1": None, "-50": None, "+50": None, "x": None, None: None, "99.99": 9899, "-104.5": -105}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert [r["a"] for r in df.select(feeds.feed_price(F.col("p")).alias("a")).collect()] == list(cases.values())


def test_box_scores_with_missing_fields(spark):
    body = {"homeTeam": {"abbrev": "AAA"}, "playerByGameStats": {"homeTeam": {"forwards": [{"playerId": 1, "blocks": 2}, {"goals": 3}], "goalies": [{"playerId": 9, "toi": "30:01", "saves": 5, "decision": "O"}]}}}
    df = bodies(spark, [(1, json.dumps(body)), (2, "{}"), (3, "not json"), (4, None)])
    assert [tuple(r) for r in feeds.skater_lines(df).collect()] == [(1, "AAA", 1, "", 0, 0, 0, 0, 0, 0, 2, 0, 0)]
    g = feeds.goalie_lines(df).collect()
    assert len(g) == 1 and g[0]["is_starter"] and g[0]["decision"] == "OTL" and g[0]["sv_pct"] is None and g[0]["saves"] == 5 and g[0]["even_shots"] == 0


def test_scratches_and_officials_count_once(spark):
    man = lambda i, f, l: {"id": i, "firstName": {"default": f}, "lastName": {"default": l}}  # noqa: E731, E741
    info = {"homeTeam": {"headCoach": {"default": " X "}, "scratches": [man(1, "A", " "), man(2, None, None), man(1, "Z", "Z")]}, "awayTeam": {"scratches": [man(1, "B", "B"), man(3, "C", "D")]}, "referees": [{"fullName": {"default": "R"}, "sweaterNumber": 4}, {"fullName": {"default": " R"}}, {"fullName": {}}]}
    df = bodies(spark, [(1, "H", "A", json.dumps({"gameInfo": info})), (2, "H", "A", "{}")], "game_id int, home string, away string, body string")
    assert sorted(map(tuple, feeds.scratches(df).collect())) == [(1, "away", "A", 3, "C D"), (1, "home", "H", 1, "A"), (1, "home", "H", 2, None)]
    assert [tuple(r) for r in feeds.officials(df).collect()] == [(1, "referee", "R", 4)]
    got = {r["game_id"]: tuple(r)[1:] for r in feeds.game_info(df).collect()}
    assert got == {1: ("ok", "X", None, 2, 1, 1, 0), 2: ("empty", None, None, 0, 0, 0, 0)}


def odd(what, value, q=None):
    return {"description": what, "value": value, "qualifier": q}


def test_partner_markets_need_every_side(spark):
    full = {"homeTeam": {"odds": [odd("MONEY_LINE_2_WAY", -120), odd("PUCK_LINE", "+180", "-1.5"), odd("OVER_UNDER", "1.95", "O6"), odd("MONEY_LINE_3_WAY", "2.3"), odd("MONEY_LINE_3_WAY", 4.2, "Draw")]}, "awayTeam": {"odds": [odd("MONEY_LINE_2_WAY", "+100"), odd("PUCK_LINE", -220, "1.5"), odd("OVER_UNDER", 1.87, "U6"), odd("MONEY_LINE_3_WAY", "2.9")]}}
    half = {"homeTeam": {"odds": [odd("MONEY_LINE_2_WAY", -120), odd("PUCK_LINE", 150, "1.5"), odd("OVER_UNDER", -110, "O6")]}, "awayTeam": {"odds": [odd("PUCK_LINE", -180, "1.5"), odd("OVER_UNDER", -110, "U5.5")]}}
    body = {"bettingPartner": {"name": "", "partnerId": 9}, "games": [{"gameId": 5, **full}, {"gameId": 6, **half}, {"homeTeam": {}}]}
    got = {(r["game_id"], r["market"]): r for r in feeds.partner_quotes(bodies(spark, [("se", json.dumps(body)), ("x", "[]")], "source string, body string")).collect()}
    assert set(got) == {(5, m) for m in ("ml", "pl", "total", "ml3")} and got[(5, "pl")]["line"] == -1.5 and got[(5, "total")]["over_price"] == -105 and got[(5, "ml3")]["draw_price"] == 320 and got[(5, "ml")]["book"] == "partner9"


def test_quotes_are_judged(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    at = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    q = spark.createDataFrame([(1, "veikkaus", at(12), None), (2, "a", at(12), None), (9, "a", at(12), None), (2, "a", at(9), None), (2, "a", at(12), "LIVE"), (3, "a", None, "FUT"), (4, "a", None, None)], "game_id int, book string, start timestamp, state string")
    games = spark.createDataFrame([(1, at(12)), (2, at(12)), (3, None), (4, at(11))], "game_id int, start timestamp")
    assert sorted(r["fate"] for r in feeds.judged_quotes(q, games, now).collect()) == ["excluded", "in_play", "in_play", "kept", "kept", "no_start", "unknown_game"]


def entry(name, athlete, value, opened, line_, line_open=None, side=None, updated="2024-01-10T10:00Z"):
    out = {"type": {"name": name}, "athlete": {"$ref": f"http://x/athletes/{athlete}?lang=en"}, "odds": {"american": {"value": value, "open": opened}, "total": {"value": line_, "open": line_open or line_}}, "lastUpdated": updated}
    return out | ({"current": {side: {"value": "x"}}} if side else {})


def test_prop_entries_become_lines(spark):
    items = [
        entry("Total Points", 1, "-110", "-120", "0.5", side="over"), entry("Total Points", 1, "-115", "+100", "0.5", side="under"),
        entry("Total Goals", 2, "+150", "+140", "0.5"), entry("Total Goals", 2, "-190", "-180", "0.5"),  # no sides: over comes first
        entry("Total Hits", 3, "-110", "-110", "1.5"),  # one without a side can't be paired
        entry("Scorer", 4, "+200", "+210", None), entry("Points Milestones", 5, "+120", "+110", "3+"),
        entry("Total Saves", 6, "-999", "-130", "30.5", "28.5", side="over", updated="2024-01-10T20:00Z"),  # during the game: the opening line
        entry("Corners", 7, "-110", "-110", "1.5", side="over"),
    ]
    df = bodies(spark, [("e", "DraftKings", dt.datetime(2024, 1, 10, 18, tzinfo=dt.timezone.utc), json.dumps(items))], "event_id string, book string, start timestamp, body string")
    got = {r["athlete_id"]: (r["market"], r["line"], r["over_price"], r["under_price"], r["over_price_open"], r["under_price_open"]) for r in feeds.prop_lines(df, {"Scorer": "scorer"}, {"Points Milestones": "player_points"}).collect()}
    assert got == {1: ("player_points", 0.5, -110, -115, -120, 100), 2: ("player_goals", 0.5, 150, -190, 140, -180), 4: ("scorer", 0.5, 200, None, 210, None), 5: ("player_points", 2.5, 120, None, 110, None), 6: ("player_total_saves", 28.5, None, None, -130, None)}
    other = df.withColumn("book", F.lit("ESPN BET"))
    assert {r["athlete_id"] for r in feeds.prop_lines(other, {}, {}).collect()} == {1, 6}


def test_rosters(spark):
    person = lambda i, n, p: {"athlete": {"id": i, "displayName": n, "shortName": n[0], "position": {"abbreviation": p}}}
    body = {"boxscore": {"players": [{"team": {"abbreviation": "T"}, "statistics": [{"athletes": [person("7", "Seven", "lw"), person("x", "No", "c")]}, {"athletes": [person("7", "Last", "g")]}]}]}}
    out = feeds.roster(bodies(spark, [(1, json.dumps(body)), (2, "{}")]), ["game_id"], {"LW": "L", "G": "G"})
    assert [tuple(r) for r in out.collect()] == [(1, 7, "Last", "L", "T", "G")]


def test_line_history_of_both_layouts(spark):
    block = {"provider": {"name": "DK"}, "overUnder": 6.5, "spread": -1.5, "total": {"over": {"open": {"line": "o6.5", "odds": "+114"}, "close": {"line": "o6.5", "odds": "-105"}}, "under": {"open": {"line": "u6.5", "odds": "+114"}, "close": {"line": "u5.5", "odds": "-115"}}}}
    r = feeds.pick_center(bodies(spark, [(1, json.dumps(block))]), ["game_id"]).first()
    # the close counts at its own line only; an opening pair that can't be is unknown
    assert (r["over_price"], r["under_price"], r["over_price_open"], r["under_price_open"], r["total_open"], r["home_ml"]) == (-105, None, None, None, 6.5, None)


def test_pages_without_line_ups(spark):
    pages = spark.createDataFrame([(1, "<html></html>"), (2, '<script id="__NEXT_DATA__" type="application/json">{"props": {}}</script>'), (3, None)], "page int, html string")
    assert feeds.lineups(pages, ["page"]).count() == 0


def appearances(spark):
    # team T: 1 starts days 0-5, 2 starts days 6 and 8; 2 came in on day 3 too. Team U: 3 on odd days
    row = lambda g, t, i, day, start, sv, sh: (g, t, i, DAY + dt.timedelta(days=day), 20232024, start, 3600 if start else 600, sv, sh)
    rows = [row(10 + d, "T", 1, d, True, 27, 30) for d in range(6)] + [row(13, "T", 2, 3, False, 5, 6), row(16, "T", 2, 6, True, 28, 30), row(18, "T", 2, 8, True, 20, 25)] + [row(50 + d, "U", 3, d, True, 25, 28) for d in (1, 3, 5)]
    return spark.createDataFrame(rows, "game_id int, team string, goalie_id int, date date, season int, is_starter boolean, toi int, saves int, shots int")


def test_roles_look_at_earlier_days_only(spark):
    asked = spark.createDataFrame([(100, "T", 1, DAY + dt.timedelta(days=8), 20232024), (101, "T", 2, DAY + dt.timedelta(days=9), 20232024), (102, "T", 9, DAY, 20232024), (103, "T", None, DAY, 20232024), (104, "T", 1, DAY + dt.timedelta(days=200), 20242025)], "game_id int, team string, goalie_id int, date date, season int")
    got = {r["game_id"]: r for r in roles.role_features(appearances(spark), asked).collect()}
    a = got[100]
    assert (a["role_start_share_10"], a["role_start_share_season"], a["role_is_primary"], a["role_rest_days"], a["role_started_yesterday"]) == (6 / 7, 6 / 7, 1.0, 3.0, 0.0)
    league = 27 * 6 + 5 + 28 + 25 * 3, 30 * 6 + 6 + 30 + 28 * 3, 11
    p, bar = league[0] / league[1], league[1] / league[2]
    own = (27 * 6 + 30 * bar * p) / (30 * 6 + 30 * bar)
    other = (33 + 30 * bar * p) / (36 + 30 * bar)
    assert abs(a["role_carry_sv"] - own) < 1e-12 and abs(a["role_starter_minus_alt"] - (own - other)) < 1e-12
    assert got[101]["role_started_yesterday"] == 1.0 and got[101]["role_is_primary"] == 0.0
    # nobody has played yet: the fallbacks; an unknown goalie; a season without a game looks at the one before
    n = got[102]
    assert (n["role_carry_sv"], n["role_starter_minus_alt"], n["role_start_share_10"], n["role_is_primary"], n["role_rest_days"], n["role_started_yesterday"]) == (0.905, 0.0, None, None, None, 0.0)
    assert got[103]["role_carry_sv"] is None and got[104]["role_start_share_season"] is None and got[104]["role_is_primary"] == 1.0 and got[104]["role_rest_days"] == 10


def test_a_side_attacks_the_other_sides_goalie(spark):
    g = spark.createDataFrame([(200, DAY + dt.timedelta(days=9), 20232024, "T", "U", 2, 3)], "game_id int, date date, season int, home string, away string, home_starter int, away_starter int")
    r = roles.defending_roles(g, appearances(spark)).first()
    assert r["home_def_role_start_share_season"] == 1.0 and r["away_def_role_start_share_season"] == 2 / 8


def test_a_stated_season_comes_before_the_one_of_the_id(spark):
    game = lambda i, **more: {"id": i, "gameType": 2, "gameState": "FUT", **more}
    week = {"gameWeek": [{"date": "2024-01-01", "games": [game(2021000005, season=20202021), game(2021000006)]}]}
    got = {r["game_id"]: r["season"] for r in tables.schedule(bodies(spark, [(1, json.dumps(week))])).collect()}
    assert got == {2021000005: 20202021, 2021000006: 20212022}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_body_is_not_copied_for_each_of_its_entries(spark):
    b = spark.range(2).select("id", F.lit("source").alias("source"), F.concat(F.lit("<html>"), F.col("id").cast("string")).alias("html"), F.concat(F.lit("{"), F.col("id").cast("string")).alias("body"))
    for df, of in ((feeds.partner_quotes(b), "games"), (feeds.schedule_quotes(b), "games"), (feeds.lineups(b, ["id"]), "players")):
        # the exploded list is dropped from the rows it gives, and no struct that holds it stands beside
        assert re.search(rf"Generate (pos)?explode\({of}#\d+\), \[\d+\], false", plan(df))


def test_a_line_up_is_read_once(spark):
    page = {"props": {"pageProps": {"combinations": {"teamName": "T", "players": [{"name": "A", "groupIdentifier": g, "positionIdentifier": s, "categoryIdentifier": k} for g, s, k in (("pp1", "s1", "pp"), ("f1", "lw", "ev"), ("f2", "c", "ev"))]}}}}
    df = feeds.lineups(bodies(spark, [(1, f'<script id="__NEXT_DATA__">{json.dumps(page)}</script>')], "page int, html string"), ["page"])
    assert {r["unit"]: r["position"] for r in df.collect()} == {"PP1": "C", "F1": "L", "F2": "C"}
    assert "Join" not in plan(df)  # the positions of even strength come from the same rows


def test_prices_come_in_bodies_of_bounded_size(spark):
    rows = spark.range(100000).select(F.col("id").alias("o_orderkey"), F.lit(20).alias("o_custkey"))
    assert rows.groupBy(F.pmod("o_custkey", F.lit(20)), readers._block()).count().agg(F.max("count")).first()[0] == readers._BODY_KEYS


def test_box_bodies_meet_once_and_are_read_without_failed_casts(spark):
    """Lines travel once, by game; strings that aren't numbers aren't cast."""
    path = "/root/testdata/sf0.001"
    for made in (readers.goalie_lines, readers.skater_lines, readers.game_info):
        plan = made(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan
    odd_clocks = spark.createDataFrame([("",), ("x",), ("1:5",), ("12:34",), (None,), ("99999999999:00",)], "c string")
    seconds = odd_clocks.select(text.clock_seconds(F.col("c")).alias("s"))
    assert [r["s"] for r in seconds.collect()] == [0, 0, 0, 754, 0, 0]
    assert "RLIKE" in seconds._jdf.queryExecution().optimizedPlan().toString()


def test_game_info_counts_each_body(spark):
    """Ids and names that are null, blank or repeated, lists that are missing, and a player of both sides."""
    man = lambda i: {"id": i}
    info = {"homeTeam": {"scratches": [man(1), man(None), man(1), None]}, "awayTeam": {"scratches": [man(1), man(2), man(2)]}, "linesmen": [{"fullName": {"default": " L"}}, {"fullName": {"default": "L "}}, {"fullName": {"default": " "}}, {"fullName": None}, None]}
    rows = [(1, json.dumps({"gameInfo": info})), (2, json.dumps({"gameInfo": {"awayTeam": {"scratches": [man(5)]}}})), (3, "not json"), (4, None), (None, json.dumps({"gameInfo": info}))]
    df = bodies(spark, [(g, "H", "A", b) for g, b in rows], "game_id int, home string, away string, body string")
    got = {r["game_id"]: tuple(r)[1:] for r in feeds.game_info(df).collect()}
    none = ("empty", None, None, 0, 0, 0, 0)
    assert got == {1: ("ok", None, None, 1, 1, 0, 1), 2: ("ok", None, None, 0, 1, 0, 0), 3: none, 4: none, None: ("ok", None, None, 1, 1, 0, 1)}
