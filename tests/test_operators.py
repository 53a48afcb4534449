"""Operators on small frames, with the cases that SQL oracles don't show."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foretime.functions import calendar as cal
from foretime.functions import guards, pmf, prices, text
from foretime.operators import joins, keyed, ledger, markets, pit, ranking, reshape, sequential, simulate, stats
from foretime.plans import features, models
from foretime.sources import sinks, tables
from foretime.streaming import changes

DAY = dt.date(2024, 1, 1)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.fixture(scope="module")
def base(spark):
    rnd = random.Random(3)
    rows = [(f"t{k % 3}", 20232024 if i < 12 else 20242025, DAY + dt.timedelta(days=2 * i + k % 2), 100 * i + k, float(rnd.randint(0, 6)), float(rnd.choice((0, 3600)))) for i in range(20) for k in range(3)]
    return spark.createDataFrame(rows, "team string, season int, date date, game_id long, gf double, toi double").cache()


def test_prior_rows_see_nothing_from_the_row_on(base):
    """Poisoning: values from a cutoff on change, results before it don't."""
    run = lambda df: {r["game_id"]: tuple(r)[6:] for r in pit.prior_ratios(df, ["team", "season"], ["date", "game_id"], {"r": ("gf", "toi", 3600.0)}, [5, 10]).collect() if r["date"] < dt.date(2024, 1, 21)}
    assert run(base) == run(pit.poison_future(base, "date", "2024-01-21", ["gf", "toi"]))


@pytest.mark.parametrize("plan", ["trailing", "expanding", "decayed"])
def test_day_frames_leave_out_the_own_day(spark, plan):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY, 2.0), ("a", DAY + dt.timedelta(1), 4.0), ("a", DAY + dt.timedelta(400), 8.0)], "k string, date date, v double")
    out = {"trailing": lambda: pit.trailing_days(df, ["k"], "date", ["v"], 365), "expanding": lambda: pit.expanding_before(df, ["k"], "date", ["v"]), "decayed": lambda: pit.decayed_before(df, ["k"], "date", ["v"], 1.0)}[plan]()
    column = out.columns[-1]
    got = {(r["date"], r["v"]): r[column] for r in out.collect()}
    assert got[(DAY, 1.0)] == got[(DAY, 2.0)] == 0
    assert got[(DAY + dt.timedelta(1), 4.0)] == (1.5 if plan == "decayed" else 3)
    assert got[(DAY + dt.timedelta(400), 8.0)] == pytest.approx({"trailing": 0, "expanding": 7, "decayed": 0}[plan], abs=1e-9)


def test_ratio_guards(spark):
    r = one(spark, a=guards.ratio(F.lit(1.0), F.lit(0.0)), b=guards.ratio(F.lit(1.0), F.lit(None).cast("double")), c=guards.per60(F.lit(2.0), F.lit(3600)), d=guards.known(F.lit(float("nan"))), e=guards.clip(F.lit(120.0), -99, 99), f=guards.stage_of(F.lit(63)))
    assert tuple(r) == (None, None, 2.0, None, 99.0, "LATE")


def test_stage_under_one_is_an_error(spark):
    with pytest.raises(Exception, match="1 or more"):
        one(spark, a=guards.stage_of(F.lit(0)))


def test_prices(spark):
    r = one(spark, a=prices.implied(F.lit(-150)), b=prices.implied(F.lit(0)), c=prices.decimal_odds(F.lit(150)), d=prices.american_odds(F.lit(2.5)), e=prices.american_odds(F.lit(1.5)), f=prices.kelly(F.lit(0.1), F.lit(2.0)), g=prices.effective_decimal(F.lit(100), F.lit("x"), {"x": 0.07}))
    assert r[0] == pytest.approx(0.6) and r[1] is None and r[2] == 2.5 and r[3] == 150 and r[4] == -200 and r[5] == 0
    assert r[6] == pytest.approx(1 / (0.5 + 0.07 * 0.25))


def test_hedges_pay_the_same_either_way(spark):
    r = one(spark, a=prices.hedge_free_bet(F.lit(100.0), F.lit(4.0), F.lit(1.4)), b=prices.hedge_boost(F.lit(10.0), F.lit(3.0), F.lit(0.5), F.lit(1.6)), c=prices.hedge_risk_free(F.lit(50.0), F.lit(3.0), F.lit(1.55)))
    h = r["a"]["hedge"]
    assert 100 * 3 - h == pytest.approx(h * 0.4) and r["a"]["profit"] == pytest.approx(h * 0.4)
    h = r["b"]["hedge"]
    assert 10 * 3 - h == pytest.approx(h * 0.6 - 10) and r["b"]["profit"] == pytest.approx(h * 0.6 - 10)
    h = r["c"]["hedge"]
    assert 50 * 2 - h == pytest.approx(h * 0.55 - 50 + 50 * 0.7) and r["c"]["profit"] == pytest.approx(100 - h)


def test_parlay(spark):
    leg = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(spark, a=prices.parlay(leg(2.0, 3.0), leg("WIN", "PUSH")), b=prices.parlay(leg(2.0, 3.0), leg("WIN", None)), c=prices.parlay(leg(2.0, 3.0), leg("LOSS", None)), d=prices.parlay(leg(2.0, 3.0), leg("VOID", "PUSH")))
    assert [x["status"] for x in r] == ["WON", "OPEN", "LOST", "PUSH"] and r["a"]["factor"] == 2.0


def test_void_and_close(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    r = one(spark, a=prices.void_reason(F.lit("PPD"), t("2024-01-01 20:00:00"), t("2024-01-01 20:00:00")), b=prices.void_reason(F.lit("OK"), t("2024-01-02 00:00:01"), t("2024-01-01 20:00:00")), c=prices.void_reason(F.lit("OK"), t("2024-01-01 21:00:00"), t("2024-01-01 20:00:00")), d=prices.closing_value(F.lit(None).cast("int"), F.lit(100), F.lit(0.55), F.lit(0.5)))
    assert tuple(r) == ("ppd", "moved", None, 0.05)


def test_pmfs_sum_to_one(spark):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    g = pmf.joint(pmf.poisson(F.lit(3.0)), pmf.poisson(F.lit(2.5)), [1.15, 0.5, 0.7, 1.3, 1.0])
    nb = pmf.negative_binomial(F.lit(2.5), 0.2)
    t = pmf.total_of(g)
    r = one(spark, a=total(pmf.poisson(F.lit(8.0))), b=total(F.flatten(g)), c=total(t), d=total(nb), e=pmf.mean(nb), f=pmf.home_win(g, F.lit(0.5)), h=pmf.nll(t, F.lit(99)), i=pmf.middle_value(t, F.lit(4.5), F.lit(7.5), F.lit(2.0), F.lit(2.0)))
    assert all(r[k] == pytest.approx(1) for k in "abcd") and r["e"] == pytest.approx(2.5, abs=0.02) and 0.5 < r["f"] < 0.7 and r["h"] is None
    assert -1 < r["i"] < 2


def test_ledger(spark):
    leg = lambda m, s, x, h, a, final=True, void=False: ledger.leg_result(F.lit(m), F.lit(s), F.lit(x).cast("double"), F.lit(h), F.lit(a), F.lit(final), F.lit(void))
    r = one(spark, a=leg("ml", "home", None, 3, 2), b=leg("pl", "away", 1.0, 3, 2), c=leg("total", "under", 5.5, 3, 3), d=leg("ml", "away", None, 1, 0, False), e=leg("ml", "away", None, 1, 0, True, True), f=leg("total", "over", None, 3, 2))
    assert tuple(r) == ("WIN", "PUSH", "LOSS", None, "VOID", None)
    rnd = random.Random(4)
    rows = [(p, 0.5, rnd.random() < 0.5 + 0.6 * (p - 0.5)) for p in (rnd.uniform(0.2, 0.8) for _ in range(4000))]
    assert abs(ledger.trust(spark.createDataFrame(rows, "p double, m double, y boolean"), "p", "m", "y") - 0.6) < 0.15


def test_calendar(spark):
    d = lambda s: F.lit(s).cast("date")
    r = one(spark, a=cal.season_of(d("2024-06-30")), b=cal.season_of(d("2024-07-01")), c=cal.utc_offset_hours(d("2024-01-10"), F.lit("America/New_York")), e=cal.utc_offset_hours(d("2024-07-10"), F.lit("America/New_York")), f=cal.haversine_km(F.lit(40.7505), F.lit(-73.9934), F.lit(34.043), F.lit(-118.2673)), g=cal.spans(d("2024-01-01"), d("2024-01-10"), 4), h=cal.season_before(F.lit(20242025)))
    assert (r["a"], r["b"], r["c"], r["e"], r["h"]) == (20232024, 20242025, -5.0, -4.0, 20232024) and abs(r["f"] - 3936) < 15
    assert [(x["first"].day, x["last"].day) for x in r["g"]] == [(1, 4), (5, 8), (9, 10)]


def test_text(spark):
    r = one(spark, a=text.clock_seconds(F.lit("12:34")), b=text.clock_seconds(F.lit("--:--")), c=text.fraction(F.lit("19/21")), d=text.strength(F.lit("5v4")), e=text.strength(F.lit("odd")), f=text.american(F.lit("EVEN")), g=text.american(F.lit("+150")), h=text.american(F.lit("50")), i=text.american(F.lit("1.91")), j=text.line(F.lit("o6.5")), k=text.line(F.lit("PK")), l=text.milestone(F.lit("3+")), m=text.plain_name(F.lit("Éric  O'Brien-Žák Jr.")), n=text.venue_key(F.lit("Bet & Win 365")))
    assert tuple(r[:2]) == (754, 0) and tuple(r["c"]) == (19, 21) and tuple(r["d"]) == (5, 4) and tuple(r["e"]) == (5, 5)
    assert (r["f"], r["g"], r["h"], r["i"], r["j"], r["k"], r["l"]) == (100, 150, None, -110, 6.5, 0.0, 2.5)
    assert r["m"] == "eric obrien zak jr" and r["n"] == "betwin365"


def test_rows_hash_ignores_order(spark):
    h = lambda rows: spark.createDataFrame(rows, "a string, b int").agg(text.rows_hash([F.col("a"), F.col("b")]).alias("h")).first()["h"]
    assert h([("x", 1), ("y", None)]) == h([("y", None), ("x", 1)]) != h([("x", 1), ("y", 2)])


def test_asof_is_strict_and_bounded(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([("k", t(0), 1), ("k", t(100), 2), ("k", t(5000), 3), ("z", t(1), 4), ("k", None, 5)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("k", t(0), "a"), ("k", t(100), "b"), ("k", t(50), "c"), ("k", t(50), "d"), ("k", None, "n")], "k string, t timestamp, v string")
    got = {r["id"]: r["match"] and r["match"]["v"] for r in pit.asof_latest(left, right, ["k"], "t", "t", 600, ["v"]).collect()}
    assert got == {1: None, 2: "d", 3: None, 4: None, 5: None}
    loose = {r["id"]: r["match"] and r["match"]["v"] for r in pit.asof_latest(left, right, ["k"], "t", "t", 600, ["v"], strict=False).collect()}
    assert loose == {1: "a", 2: "b", 3: None, 4: None, 5: None}


def test_keyed_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, None), (3, "c", 3)], "k int, v string, n int")
    assert sorted(map(tuple, keyed.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
    assert sorted(r["k"] for r in keyed.insert_new(old, new, ["k"]).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        keyed.assert_unique(old.union(old), ["k"])
    path = str(tmp_path / "t")
    sinks.season_table(old.withColumnRenamed("k", "season"), path)
    sinks.season_table(new.withColumnRenamed("k", "season"), path)
    assert sorted((r["season"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, None), (3, "c")]
    known = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, 5)], "k int, t int, a string, b int")
    assert tuple(keyed.latest_known(known, ["k"], "t", ["a", "b"]).first()) == (1, "x", 5)


def test_names(spark):
    people = spark.createDataFrame([(1, "BOS", "Jöhn Smith"), (2, "NYR", "Jack Smith"), (3, "NYR", "Ann Lee"), (4, "BOS", "Amy Lee")], "id int, team string, name string")
    mentions = spark.createDataFrame([("JOHN SMITH", "XXX"), ("J Smith", "NYR"), ("J. Smith", "XXX"), ("X Lee", "BOS"), ("Nobody", "BOS")], "name string, team string")
    got = {r["name"]: r["id"] for r in joins.resolve_names(mentions, people, "name", "team", "id").collect()}
    assert got == {"JOHN SMITH": 1, "J Smith": 2, "J. Smith": None, "X Lee": 4, "Nobody": None}


def test_closest_day(spark):
    left = spark.createDataFrame([("a", DAY), ("b", DAY), ("c", DAY)], "k string, d date")
    right = spark.createDataFrame([("a", DAY + dt.timedelta(1), 1), ("b", DAY + dt.timedelta(1), 2), ("b", DAY - dt.timedelta(1), 3), ("c", DAY, 4), ("c", DAY + dt.timedelta(1), 5)], "k string, e date, id int")
    assert {r["k"]: r["id"] for r in joins.closest_day(left, right, ["k"], "d", "e", "id").collect()} == {"a": 1, "b": None, "c": 4}


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([("g", 5.0), ("g", 3.0), ("g", 3.0), ("g", 1.0), ("g", None)], "g string, v double")
    got = sorted((r["v"], r["r"]) for r in df.withColumn("r", ranking.average_rank(["g"], "v")).collect() if r["v"] is not None)
    assert got == [(1.0, 4.0), (3.0, 2.5), (3.0, 2.5), (5.0, 1.0)]
    assert one(spark, a=ranking.bit_reversal(F.lit(3), 4))["a"] == 12


def _elo_loop(games):
    rating, seen, out = {}, {}, {}
    for g in sorted(games, key=lambda g: (g[2], g[1])):
        for s in (g[4], g[5]):
            rating.setdefault(s, 1500.0)
            if seen.setdefault(s, g[3]) != g[3]:
                rating[s] += (1500 - rating[s]) / 3
                seen[s] = g[3]
        h, a = rating[g[4]], rating[g[5]]
        out[g[1]] = (round(h, 1), round(a, 1))
        if g[8]:
            e = 1 / (1 + 10 ** (-(h + 50 - a) / 400))
            w = 1.0 if g[6] > g[7] else 0.0
            rating[g[4]] += 20 * (w - e)
            rating[g[5]] -= 20 * (w - e)
    return out


def test_elo(spark):
    rnd = random.Random(1)
    games = []
    for i in range(200):
        h, a = rnd.sample("abcdef", 2)
        games.append(("L", i, DAY + dt.timedelta(i // 3), 1 + i // 100, h, a, rnd.randint(0, 3), rnd.randint(4, 6) if rnd.random() < 0.5 else -1, rnd.random() < 0.9))
    df = spark.createDataFrame(games, "league string, game_id long, date date, season int, home string, away string, home_score int, away_score int, final boolean")
    got = {r["game_id"]: (r["home_rating"], r["away_rating"]) for r in sequential.elo(df).collect()}
    assert got == _elo_loop(games)


def test_allocation(spark):
    rnd = random.Random(2)
    bets = [(d, k, f"i{rnd.randint(0, 3)}", rnd.random(), rnd.choice((0.01, 0.02, 0.03))) for d in range(5) for k in range(12)]
    df = spark.createDataFrame(bets, "day int, id int, item string, edge double, stake double")
    got = {(r["day"], r["id"]): r["kept"] for r in sequential.allocate(df, ["day"], "item", "edge", "stake", [-F.col("edge"), F.col("id")]).collect()}
    want = {}
    for d in range(5):
        used, items = 0.0, {}
        for b in sorted((b for b in bets if b[0] == d), key=lambda b: (-b[3], b[1])):
            mine = items.setdefault(b[2], [])
            ok = used + b[4] <= 0.1 + 1e-9 and sum(mine) + b[4] <= 0.04 + 1e-9 and len(mine) < 3
            if ok:
                used += b[4]
                mine.append(b[4])
            want[(d, b[1])] = ok
    assert got == want


def test_bankroll(spark):
    bets = [("s", 1, 1, 0.06, 1.0), ("s", 1, 2, 0.06, 1.0), ("s", 1, 3, 0.04, -1.0), ("s", 2, 4, 0.1, -1.0)]
    out = sequential.bankroll(spark.createDataFrame(bets, "s string, d int, id int, stake double, gain double"), "s", "d", ["id"], "stake", "gain").orderBy("day").collect()
    assert [(r["bets"], round(r["balance"], 6)) for r in out] == [(2, 1020.0), (1, 918.0)] and out[1]["drawdown"] == pytest.approx(0.1)


def test_simulation_is_repeatable(spark):
    days = [[(0.05, 1.0, 0.55), (0.06, 0.9, 0.5)], [(0.02, 1.2, 0.5)]]
    a, b = (sorted(map(tuple, simulate.seasons(spark, days, 50, 30).repartition(n).collect())) for n in (1, 5))
    assert a == b
    s = simulate.summary(simulate.seasons(spark, days, 50, 30)).first()
    assert s["p5"] <= s["p50"] <= s["p95"]


def test_markets(spark):
    q = spark.createDataFrame([("g", "a", -120, 110), ("g", "b", -110, 100), ("g", "c", 105, -130), ("h", "a", -120, 110), ("h", "b", -115, 105), ("h", "c", 110, -125)], "item string, venue string, home int, away int")
    c = {r["item"]: r for r in markets.consensus(q, ["item"]).collect()}
    assert c["g"]["best_home"] == 105 and c["g"]["best_home_venue"] == "c" and c["g"]["venues"] == 3
    assert [r["venue"] for r in markets.swapped_venues(q, ["item"]).collect()] == ["c"]
    assert {r["item"] for r in markets.arbitrages(q, ["item"]).collect()} == {"g", "h"}
    assert one(spark, a=markets.in_play(F.lit(-1200), F.lit(700), F.lit(None).cast("double")))["a"]
    moved = markets.price_move(q, q.withColumn("home", F.lit(-200)), ["item"], 0.05).collect()
    assert all(r["moved"] for r in moved)


def test_features(spark, base):
    out = features.team_rolling(base.withColumns({c: F.lit(1.0) for c in ("ga", "xgf", "xga", "sog_for", "pp_goals", "pp_opps", "fow", "fo_total", "pim")}))
    first = out.filter("rows_82 = 0").collect()
    assert len(first) == 6 and all(r["gf_per60_5"] is None for r in first)
    games = spark.createDataFrame([(1, 1, DAY, "NY", "LA", 40.75, -73.99, "America/New_York"), (2, 1, DAY + dt.timedelta(1), "LA", "NY", 34.04, -118.27, "America/Los_Angeles")], "game_id int, season int, date date, home string, away string, lat double, lon double, zone string")
    r = {x["game_id"]: x for x in features.schedule_features(games).collect()}
    assert r[1]["home_rest"] is None and r[1]["home_b2b"] is False and r[2]["home_b2b"] is True and abs(r[2]["home_travel_km"] - 3936) < 15 and r[2]["home_tz_shift"] == -3
    team = spark.createDataFrame([(1, "NY", 2.0), (1, "LA", None)], "game_id int, team string, x double")
    v = {x["game_id"]: x for x in features.game_vectors(games, team, ["x"]).collect()}
    assert v[1]["vector"] == [0.0, 0.5, 0.0] and v[1]["names"] == ["x_diff", "fair_home", "priced"]
    g = spark.createDataFrame([("NY", 1, 7, False, 3000, ), ("NY", 1, 8, True, 10)], "team string, game_id int, goalie_id int, is_starter boolean, toi int")
    assert features.starters(g).first()["goalie_id"] == 8


def test_walk_forward_models(spark):
    rnd = random.Random(5)
    rows = []
    for s in range(3):
        for i in range(150):
            x = rnd.gauss(0, 1)
            rows.append((s, DAY + dt.timedelta(days=365 * s + i), x, float(rnd.random() < 1 / (1 + 2.718 ** (-1.5 * x))), float(max(0, round(3 * 2.718 ** (0.2 * x) + rnd.gauss(0, 1)))), 3.0))
    df = spark.createDataFrame(rows, "season int, date date, x double, y double, n double, env double").cache()
    p = models.walk_forward_logistic(df, ["x"], "y")
    assert {r["fold"] for r in p.select("fold").distinct().collect()} == {1, 2}
    assert stats.scores(p, "y", "p").first()["log_loss"] < 0.62
    assert stats.auc(p, "y", "p").first()["auc"] > 0.7
    rate = models.walk_forward_poisson(df, ["x"], "n", "env")
    assert rate.filter("rate < 0.4 OR rate > 8").count() == 0 and rate.agg(F.corr("rate", "x")).first()[0] > 0.8
    parts = models.assign_folds(df.select("season", "date")).filter("part = 'train'")
    assert parts.filter("season >= fold").count() == 0
    assert models.core_and_tail(df, "date").groupBy("part").count().count() == 2
    a, b = models.temperature(p.withColumn("logit", F.ln(F.col("p") / (1 - F.col("p")))), "logit", "y")
    assert 0.5 < a < 2 and abs(b) < 0.5


def test_sources(spark, tmp_path):
    body = '{"timestamp":"2024-01-01T10:00:00Z","previous_timestamp":null,"next_timestamp":null,"data":[{"id":"e","commence_time":"2024-01-01T12:00:00Z","home_team":"A","away_team":"B","bookmakers":[{"key":"v","last_update":"2024-01-01T09:59:00Z","markets":[{"key":"h2h","outcomes":[{"name":"A","price":-110,"point":null},{"name":"B","price":100,"point":null}]}]}]},{"id":"late","commence_time":"2024-01-01T09:00:00Z","home_team":"A","away_team":"B","bookmakers":[{"key":"v","last_update":"x","markets":[{"key":"h2h","outcomes":[{"name":"A","price":1,"point":null}]}]}]}]}'
    import gzip

    with gzip.open(tmp_path / "q.json.gz", "wt") as f:
        f.write(body)
    q = tables.quotes(tables.json_bodies(spark, str(tmp_path)))
    assert sorted((r["side"], r["price"]) for r in q.collect()) == [("away", 100), ("home", -110)]
    page = spark.createDataFrame([("<table><tr><th>No</th></tr><tr><td><b>7</b></td><td>A&nbsp;B</td></tr></table><script id=\"d\">{\"a\": 3}</script>",)], "html string")
    assert [r["cells"] for r in tables.html_rows(page).orderBy("row_no").collect()] == [["No"], ["7", "A B"]]
    assert tables.embedded_json(page, "a int", "d").first()["data"]["a"] == 3
    shifts = '{"data":[{"id":9,"gameId":1,"playerId":5,"period":1,"startTime":"00:10","endTime":"00:40","duration":null,"teamAbbrev":"A","typeCode":517},{"id":8,"gameId":1,"playerId":5,"period":1,"startTime":"00:10","endTime":"00:50","duration":"00:40","teamAbbrev":"A","typeCode":517},{"id":1,"gameId":2,"playerId":5,"period":1,"startTime":"00:10","endTime":"00:50","duration":"00:40","teamAbbrev":"A","typeCode":517}]}'
    r = tables.shifts(spark.createDataFrame([(1, shifts)], "game_id long, body string")).collect()
    assert [(x["shift_id"], x["duration"]) for x in r] == [(8, 40)]
    (tmp_path / "e.csv").write_text("shot_id,season,game_id,home_team,away_team,team,period,time,event,x,y,shot_type,shooter_id,goalie_id,skaters_home,skaters_away,home_score,away_score,goal,xg\n1,2023,20001,T.B,BOS,HOME,1,30,SHOT,1,2,,5,6,5,4,1,0,1,NaN\n")
    e = tables.event_file(spark, str(tmp_path / "e.csv"), renamed={"TB": "TBL"}).first()
    assert (e["game_id"], e["home_team"], e["strength"], e["shot_type"], e["xg"], e["is_goal"]) == (2023020001, "TBL", "5v4", "WRIST", None, True)


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    src = str(tmp_path / "in")
    rows = [("a", t(1), "x"), ("a", t(2), "x"), ("a", t(3), "y"), ("b", t(1), "z")]
    schema = "k string, ts timestamp, digest string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = changes.snapshots(spark, src, spark.createDataFrame([], schema).schema)
    q = changes.store_on_change(stream, "k", "ts", "digest").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["digest"]) for r in spark.table("kept").collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    q = changes.write_idempotent(changes.snapshots(spark, src, spark.createDataFrame([], schema).schema), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    batch = changes.changes(spark.createDataFrame(rows, schema), ["k"], ["ts"], ["digest"])
    assert batch.count() == 3


def test_due(spark):
    now = "2024-01-01 10:00:00"
    t = lambda h: dt.datetime(2024, 1, 1, h)
    starts = spark.createDataFrame([(1, t(11)), (2, t(11)), (3, t(15)), (4, t(10))], "k int, start timestamp")
    last = spark.createDataFrame([(2, dt.datetime(2024, 1, 1, 9, 55))], "k int, ts timestamp")
    assert [r["k"] for r in changes.due(starts, last, "k", "start", "ts", now, "2 HOURS", "10 MINUTES").collect()] == [1]


def test_sides_and_back(spark):
    df = spark.createDataFrame([(1, "A", "B", 3, 2)], "g int, h string, a string, hs int, as_ int")
    s = reshape.sides(df, ["g"], {"team": "h", "score": "hs"}, {"team": "a", "score": "as_"})
    assert tuple(reshape.pair_sides(s, ["g"], "is_home", ["team", "score"]).select("home_team", "away_team", "home_score", "away_score").first()) == ("A", "B", 3, 2)


def test_whole_row_numbers_of_a_large_table(spark):
    """Ranges are sampled: with so many rows and columns, two passes over them would not agree."""
    rows = spark.range(2_000_000).select(F.xxhash64("id").alias("x"), "id", F.md5(F.col("id").cast("string")).alias("payload"), (F.col("id") % 7).alias("other"))
    out = ranking.whole_row_number(rows.repartition(16), ["x", "id"], count="n").agg(F.countDistinct("row_no"), F.min("row_no"), F.max("row_no"), F.min("n"), F.max("n")).first()
    assert tuple(out) == (2_000_000, 1, 2_000_000, 2_000_000, 2_000_000)
    bins = ranking.equal_count_bins(rows, ["x", "id"], 7).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect()
    assert [r["bin"] for r in bins] == list(range(7)) and {r["n"] for r in bins} <= {285_714, 285_715}
    assert all(a["hi"] <= b["lo"] for a, b in zip(bins, bins[1:]))


def test_row_numbers_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "k int, v string")
    assert ranking.whole_row_number(empty, ["k", "v"]).count() == 0
    rows = spark.createDataFrame([(None, "a"), (2, None), (2, "b"), (None, None)], "k int, v string")
    assert [(r["k"], r["v"]) for r in ranking.whole_row_number(rows, ["k", "v"]).orderBy("row_no").collect()] == [(None, None), (None, "a"), (2, None), (2, "b")]


def test_folded_texts_equal_the_decomposition_of_every_code_point(spark):
    import unicodedata

    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and (k < 0x30000 or k % 997 == 0)]
    texts = ["".join(points[k : k + 128]) for k in range(0, len(points), 128)]
    names = ["Éric  O\u2019Brien", "Straße", "ﬁnal Ǆ ½", "한국", "e\u0301\u0327", "", "İstanbul", "Ⅷ 𝕬𝖇"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + names)], "k int, t string").repartition(8)
    got = {r["k"]: r["f"] for r in df.select("k", text.folded(F.col("t")).alias("f")).collect()}
    bad = [k for k, t in enumerate(texts + names) if got[k] != fold(t)]
    assert not bad
    assert one(spark, n=text.plain_name(F.lit("Łukasz Ødegård-Žák")))["n"] == "lukasz odegard zak"
