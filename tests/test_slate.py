"""The slate path and player features on small frames."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foretime.operators.ranking import rank_share
from foretime.plans import boosting, players, slate
from foretime.plans.features import team_rates

DAY = dt.date(2024, 1, 1)
SUMS = "gf ga xgf xga cf ca ff fa toi sog_for sog_against pp_goals pp_opps ppga opp_pp_opps pp_xgf pk_xga pp_toi sh_toi fow fo_total pim".split()


@pytest.fixture(scope="module")
def history(spark):
    rnd = random.Random(2)
    rows = [(f"t{k}", 2024, DAY + dt.timedelta(days=2 * i), 100 * i + k // 2, *[float(rnd.randint(1, 9)) for _ in SUMS]) for i in range(15) for k in range(4)]
    return spark.createDataFrame(rows, "team string, season int, date date, game_id long, " + ", ".join(f"{c} double" for c in SUMS)).cache()


def slate_of(spark, day, pairs, extra=()):
    return spark.createDataFrame([(9000 + k, 2024, day, a, b, *extra) for k, (a, b) in enumerate(pairs)], "game_id long, season int, date date, home string, away string" + "".join(f", {c}" for c in ("home_score int, away_score int",) if extra))


def test_live_rates_equal_the_stored_ones(spark, history):
    """The slate is a day that was played: its own rows and later ones make no difference."""
    day = DAY + dt.timedelta(days=20)
    live = {(r["team"]): tuple(r)[2:] for r in slate.team_asof(history, slate_of(spark, day, [("t0", "t1"), ("t2", "t3")]), [3, 8]).collect()}
    names = [c for c in slate.team_asof(history, slate_of(spark, day, [("t0", "t1")]), [3, 8]).columns if c not in ("game_id", "team")]
    stored = {r["team"]: tuple(r[n] for n in names) for r in team_rates(history, [3, 8]).filter(F.col("date") == day).collect()}
    assert live == stored and len(live) == 4


def test_a_side_without_history_and_two_dates(spark, history):
    out = slate.team_asof(history, slate_of(spark, DAY + dt.timedelta(days=50), [("t0", "new")]), [5]).filter("team = 'new'").first()
    assert out["games_5"] == 0 and out["gf_per60_5"] is None
    two = slate_of(spark, DAY, [("t0", "t1")]).unionByName(slate_of(spark, DAY + dt.timedelta(days=1), [("t2", "t3")]))
    with pytest.raises(Exception, match="one date in a season"):
        slate.team_asof(history, two, [5]).collect()


def test_starters_are_announced_or_projected(spark):
    day = DAY + dt.timedelta(days=30)
    # team a: 7 started eleven times, but of the last ten 8 has six; team b: equal counts, 5 started last
    starts = [("a", 2024, DAY + dt.timedelta(days=k), k, 7 if k < 10 else 8) for k in range(16)] + [("b", 2024, DAY + dt.timedelta(days=k), k, 5 if k % 2 else 4) for k in range(6)]
    starts.append(("a", 2024, day, 99, 9))  # of the slate's own day
    df = spark.createDataFrame(starts, "team string, season int, date date, game_id long, goalie_id int")
    s = slate_of(spark, day, [("a", "b"), ("c", "d")])
    got = {r["team"]: (r["goalie_id"], r["fallback"]) for r in slate.project_starters(df, s).collect()}
    assert got == {"a": (8, 1), "b": (5, 1), "c": (None, 1), "d": (None, 1)}
    named = spark.createDataFrame([("a", day, 3, True), ("b", day, 6, False), ("c", day, None, True), ("d", DAY, 1, True)], "team string, date date, goalie_id int, confirmed boolean")
    got = {r["team"]: (r["goalie_id"], r["fallback"]) for r in slate.project_starters(df, s, named).collect()}
    assert got == {"a": (3, 0), "b": (6, 1), "c": (None, 1), "d": (None, 1)}


def context(games):
    return games.withColumns({f"{p}_{n}": F.lit(None).cast("double") for p in ("home", "away") for n in ("elo", "rest", "b2b", "travel_km", "tz_shift", "game_num")} | {"stage": F.lit("EARLY")})


def test_vectors_have_every_name_and_refuse_other_scorers(spark, history):
    day = DAY + dt.timedelta(days=40)
    games = context(slate_of(spark, day, [("t0", "t1"), ("t2", "new")], (None, None)))
    goalies = spark.createDataFrame([("t0", 1, 2024, DAY, 0, 20, 25, 0.5, 3600)], "team string, goalie_id int, season int, date date, game_id long, saves int, shots int, gsax double, toi int").withColumns({c: F.lit(0) for c in ("hd_goals", "hd_att", "fen_goals", "fen_att", "xga")})
    market = spark.createDataFrame([(9000, 0.6)], "game_id long, fair_home double")
    out = slate.slate_vectors(games, history, goalies, goalies, slate.league_priors(goalies, F.col("season") + 1), None, market, [5])
    rows = {r["game_id"]: r for r in out.collect()}
    names = slate.feature_names([5])
    assert set(names) <= set(out.columns) and rows[9000]["market_available"] == 1 and rows[9001]["market_prob"] == 0.5
    # against a side without rows, no rate differs
    assert rows[9001]["gf_per60_diff_w5"] == 0 and rows[9001]["gp_home_w5"] == 5 and rows[9001]["gp_away_w5"] == 0
    assert rows[9000]["home_goalie"] == 1 and rows[9000]["stage_early"] == 1 and rows[9000]["starter_fallback_home"] == 1
    blind = boosting.Trees(names[:-2], [[] for _ in names[:-2]], boosting.Settings())
    scorer = boosting.Scorer(names, boosting.Trees(names, [[] for _ in names], boosting.Settings()), (1.0, 0.0), blind, (1.0, 0.25), 1, "2024-01-01")
    scored = {r["game_id"]: r["prob_home"] for r in slate.score_slate(out, scorer).collect()}
    assert scored[9000] == pytest.approx(0.6) and scored[9001] == pytest.approx(1 / (1 + 2.718281828 ** -0.25))
    with pytest.raises(ValueError, match="not the features"):
        slate.score_slate(out.drop("elo_diff"), scorer)
    with pytest.raises(Exception, match="isn't finite"):
        slate.finite(out.withColumn("elo_diff", F.lit(float("nan"))), names).collect()


def test_market_leaves_out_lines_of_games_in_play(spark):
    lines = spark.createDataFrame([(1, -110, -110, 6.0), (2, -1500, 800, 6.0), (3, None, 120, 6.0), (4, -120, 100, 9.0)], "game_id long, home_ml int, away_ml int, over_under double")
    assert [(r["game_id"], r["fair_home"]) for r in slate.market_of_lines(lines).collect()] == [(1, 0.5)]


def test_a_game_counts_its_time_once_for_each_shot(spark):
    app = spark.createDataFrame([(1, 7, 2024, 3600), (2, 7, 2024, 1800), (3, 7, 2024, 0)], "game_id long, goalie_id int, season int, toi int")
    shots = spark.createDataFrame([(1, 7, True, 0.25), (1, 7, False, 0.5), (3, 7, True, 0.9)], "game_id long, goalie_id int, goal boolean, xg double")
    assert players.gsax60_prior(app, shots).first()["gsax60"] == pytest.approx(3600 * (0.75 - 1) / (3600 * 2 + 1800))
    assert players.gsax60_prior(app, shots.limit(0)).first()["gsax60"] is None


def test_power_play_strengths(spark):
    codes = ["5v4", "5v3", "6v4", "6v5", "5v5", "4v5", None, "x"]
    df = spark.createDataFrame([(c,) for c in codes], "s string")
    assert [r["s"] for r in df.filter(players.is_power_play(F.col("s"))).collect()] == ["5v4", "5v3", "6v4"]


def player_frames(spark, change=0):
    rnd = random.Random(5)
    skaters, games, attempts, team = [], [], [], []
    for g in range(24):
        day = DAY + dt.timedelta(days=3 * g)
        late = change if g >= 18 else 0
        games.append((g, 2024, day, 2, "a", "b", "FINAL"))
        for p in range(6):
            side = "ab"[p % 2]
            skaters.append((p, g, side, "D" if p < 2 else "C", rnd.randint(600, 1200) + late, rnd.randint(0, 5) + late, rnd.randint(0, 200), rnd.randint(0, 100), rnd.randint(0, 9), rnd.randint(0, 9), g % 5 > 0))
            if g % 4:
                attempts.append((g, p, rnd.randint(1, 9) + late))
        team += [(g, "a", 30 + g + late), (g, "b", 25 + g)]
    return (
        spark.createDataFrame(skaters, "player_id int, game_id int, team string, position string, toi_seconds int, shots int, pp_toi int, sh_toi int, fow int, fol int, stats_known boolean"),
        spark.createDataFrame(games, "game_id int, season int, date date, game_type int, home string, away string, state string"),
        spark.createDataFrame(attempts, "game_id int, player_id int, attempts int"),
        spark.createDataFrame(team, "game_id int, team string, sog int"),
    )


def test_players_know_nothing_of_later_games(spark):
    """Values from game 18 on change; features up to game 18 don't."""
    shown = lambda df: {(r["player_id"], r["game_id"]): {c: r[c] for c in df.columns if c not in ("toi", "sog", "att", "team_pp", "team_pk", "pp_toi", "sh_toi")} for r in df.filter("game_id <= 18").collect()}
    before, after = (shown(players.player_features(*player_frames(spark, change))) for change in (0, 500))
    assert before == after and len(before) == 6 * 19
    first = before[(3, 0)]
    assert first["n_prior"] == 0 and first["league_pos_sog60"] == 7.0 and first["b0_mean"] == 1.9 and first["sog60_l5_rel"] is None and first["decay_index"] == 1.0


def test_games_missed_by_the_present_team(spark):
    games = spark.createDataFrame([(g, 2024, DAY + dt.timedelta(days=g), 2, *("ab" if g % 2 else "ac"), "FINAL") for g in range(8)], "game_id int, season int, date date, game_type int, home string, away string, state string")
    row = lambda p, team, day, last: (p, team, DAY + dt.timedelta(days=day), DAY + dt.timedelta(days=last) if last is not None else None)
    # 1 stayed with a; 2 came from a to b, which plays on odd days; 3 never played
    df = spark.createDataFrame([row(1, "a", 6, 2), row(2, "b", 7, 2), row(3, "c", 4, None)], "player_id int, team string, date date, last_date date")
    got = {r["player_id"]: (r["team_games_missed"], r["b2b"]) for r in players.with_schedule(df, games).collect()}
    assert got == {1: (3.0, 1.0), 2: (2.0, 0.0), 3: (None, 0.0)}


def test_slates_read_the_lines_once(spark, small):
    from foretime.plans import live

    for query in (live.slate_vectors, live.attack_rows, live.goalie_roles):
        assert not [f for f in query(spark, small).inputFiles() if "lineitem" in f or "orders" in f], query.__name__


def test_player_features_read_the_lines_once(spark, small):
    from foretime.plans import skaters

    for query in (skaters.player_features, skaters.player_xg):
        assert not [f for f in query(spark, small).inputFiles() if "lineitem" in f or "orders" in f], query.__name__


def test_players_features_stay_where_they_are_made(spark, small):
    """The result shuffles what was played, once; rows with all features are neither shuffled nor sorted."""
    from foretime.plans import skaters

    df = skaters.player_features(spark, small)
    plan = [re.sub(r"^[ :+-]*(\*\(\d+\) )?", "", x) for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    shuffled = [k for k, x in enumerate(plan) if x.startswith("Exchange")]
    assert len(shuffled) == 1 and plan[shuffled[0] + 1].startswith("FileScan"), plan
    assert not [x for x in plan if x.startswith("SortMergeJoin")]
    above = plan[: next(k for k, x in enumerate(plan) if x.startswith("Window") and "__day" in x and "game_id" in x)]
    assert not [x for x in above if x.startswith("Sort ")]


def test_steps_of_players_leave_no_shuffle_files(spark, small):
    from foretime.plans import skaters

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, kept = files(), [skaters.player_features(spark, small)]
    for _ in range(50):  # files go in the background
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and kept


def test_ranks_of_a_lineup_in_one_sort(spark):
    rnd = random.Random(3)
    rows = [(k % 4, rnd.choice([None, 1.0, 2.0, 2.5, 4.0])) for k in range(60)] + [(9, 1.0), (10, None), (11, None), (11, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    out = df.select("*", players._rank_share(["g"], "v").alias("a"), rank_share(["g"], "v").alias("b")).collect()
    assert [r["a"] for r in out] == [r["b"] for r in out] and {r["a"] for r in out} >= {None, 0.0}


def test_player_xg_shuffles_what_its_features_need_once(spark, small):
    from foretime.plans import skaters

    plan = [re.sub(r"^[ :+-]*(\*\(\d+\) )?", "", x) for x in skaters.player_xg(spark, small)._jdf.queryExecution().executedPlan().toString().splitlines()]
    shuffled = [k for k, x in enumerate(plan) if x.startswith("Exchange")]
    assert len(shuffled) == 1 and plan[shuffled[0] + 1].startswith("FileScan") and not [x for x in plan if x.startswith("SortMergeJoin")], plan
    read = plan[shuffled[0] + 1]
    assert not [c for c in ("pp_sog", "fow", "sh_toi") if f"{c}#" in read]
