"""Versioned tables, settlement twice and after a failure, slips and legs; margin weights; the stream of starters."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from foretime.operators import pit, stats
from foretime.functions import pmf
from foretime.plans import margins, settling
from foretime.sources.versions import Versions
from foretime.streaming import news

T = lambda day, hour=0: dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tables_switch_together_or_not_at_all(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    one, two = spark.range(3).toDF("n"), spark.range(5).toDF("n")
    with pytest.raises(ValueError, match="no table"):
        v.read("a")
    assert v.commit({"a": one, "b": one}) == 1 and v.commit({"b": two}) == 2
    assert (v.read("a").count(), v.read("b").count(), v.read("b", 1).count()) == (3, 5, 3)
    # a failure in the middle: the first table is written, the second isn't
    with pytest.raises(Exception, match="broken"):
        v.commit({"a": two, "b": two.withColumn("n", F.raise_error(F.lit("broken")).cast("long"))})
    assert v.current() == 2 and v.read("a").count() == 3
    # of two writers from one version the second fails
    base = v.current()
    v.commit({"a": two}, base)
    with pytest.raises(RuntimeError, match="another writer"):
        v.commit({"a": one}, base)
    assert v.read("a").count() == 5 and v.current() == 3


def ledgers(spark, path):
    v = Versions(spark, f"file://{path}/ledger")
    rec = lambda i, game, side, price, at=T(1): (i, game, side, "x", price, 10.0, 0.5, at, T(1), T(10, 19), "ISSUED")
    recs = spark.createDataFrame([rec(1, 1, "HOME", 150), rec(2, 1, "AWAY", -120), rec(3, 2, "HOME", 100), rec(4, 3, "HOME", 100), rec(5, 4, "AWAY", 200, None)], "rec_id int, game_id int, side string, book string, price int, stake double, fair_prob double, priced_at timestamp, created_at timestamp, scheduled_start timestamp, status string")
    bets = spark.createDataFrame([], "rec_id int, game_id int, date date, book string, price int, stake double, placed_at timestamp, result string, pnl double, closing_price int, clv double")
    v.commit({"recommendations": recs, "bets": bets})
    game = lambda i, state, sched, h, a, start=T(10, 19): (i, dt.date(2024, 1, 10), start, sched, h, a, state)
    games = spark.createDataFrame([game(1, "FINAL", "OK", 3, 2), game(2, "FUT", "PPD", None, None), game(3, "LIVE", "OK", 1, 0), game(4, "OFF", "OK", 1, 0, T(10, 23))], "game_id int, date date, start timestamp, schedule_state string, home_score int, away_score int, game_state string")
    quote = lambda g, book, at, h, a: (g, book, at, h, a)
    quotes = spark.createDataFrame([quote(1, "x", T(9), 130, -150), quote(1, "x", T(10), 120, -140), quote(1, "x", T(11), 100, -110), quote(1, "y", T(10), -110, -110), quote(1, "x", T(1), 999, -999)], "game_id int, book string, captured_at timestamp, home_price int, away_price int")
    return v, games, quotes


def test_settling_twice_changes_nothing(spark, tmp_path):
    v, games, quotes = ledgers(spark, tmp_path)
    settling.settle_bets(v, games, quotes)
    bets, recs = rows(v.read("bets")), rows(v.read("recommendations"))
    got = {b[0]: (b[7], b[8], b[9], b[10]) for b in bets}
    assert got[1] == ("WIN", 15.0, 120, round(100 / 220 - 100 / 250, 4)) and got[2][:3] == ("LOSS", -10.0, -140)
    # postponed; moved by four hours; game 3 isn't over
    assert got[3] == ("VOID", 0.0, None, None) and got[5][0] == "VOID" and 4 not in got
    settling.settle_bets(v, games, quotes)
    assert rows(v.read("bets")) == bets and rows(v.read("recommendations")) == recs
    broken = games.withColumn("home_score", F.when(F.col("game_id") == 3, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("home_score"))).withColumn("game_state", F.lit("FINAL"))
    with pytest.raises(Exception, match="broken"):
        settling.settle_bets(v, broken, quotes)
    assert rows(v.read("bets")) == bets
    settling.settle_bets(v, games.withColumn("game_state", F.lit("FINAL")), quotes)
    assert {b[0]: b[7] for b in rows(v.read("bets"))}[4] == "WIN" and v.read("recommendations").filter("status = 'SETTLED'").count() == 5


def test_closing_quote_of_another_book(spark, tmp_path):
    _, games, quotes = ledgers(spark, tmp_path)
    bet = spark.createDataFrame([(1, 1, "AWAY", "z", None, T(10, 19)), (2, 2, "AWAY", "z", None, None)], "rec_id int, game_id int, side string, book string, priced_at timestamp, start timestamp")
    r = settling.closing_quotes(bet, quotes).collect()
    fair = lambda h, a: h / (h + a)
    away = 1 - (fair(100 / 220, 140 / 240) + 0.5) / 2
    assert [(x["rec_id"], x["closing_price"], pytest.approx(x["closing_prob"])) for x in r] == [(1, None, away)]


def test_legs(spark):
    cases = [
        ("ml", "home", None, 3, 2, True, "OK", None, False, "WIN"), ("ml", "away", None, 3, 2, True, "OK", None, False, "LOSS"), ("ml", "home", None, 2, 2, True, "OK", None, False, None), ("pl", "away", 1.5, 3, 2, True, "OK", None, False, "WIN"), ("pl", "home", -1.0, 3, 2, True, "OK", None, False, "PUSH"),
        ("total", "under", 5.5, 3, 2, True, "OK", None, False, "WIN"), ("total", "over", 5.0, 3, 2, True, "OK", None, False, "PUSH"), ("prop_sog", "over", 2.5, 3, 2, True, "OK", 3, True, "WIN"), ("prop_sog", "under", 2.5, 3, 2, True, "OK", 3, True, "LOSS"), ("prop_sog", "over", 2.5, 3, 2, True, "OK", None, True, "VOID"),
        ("prop_sog", "over", 2.5, 3, 2, True, "OK", None, False, None), ("other", "over", 2.5, 3, 2, True, "PPD", None, False, None), ("ml", "home", None, None, None, False, "CNCL", None, False, "VOID"), ("ml", "home", None, 1, 0, False, "OK", None, False, None),
    ]
    df = spark.createDataFrame(cases, "market string, side string, line double, h int, a int, final boolean, state string, shots int, box boolean, want string")
    got = df.withColumn("got", settling.leg_outcome(*[F.col(c) for c in ("market", "side", "line", "h", "a", "final", "state", "shots", "box")]))
    assert [r["got"] for r in got.collect()] == [c[-1] for c in cases]
    with pytest.raises(Exception, match="unknown market"):
        df.limit(1).withColumn("market", F.lit("corners")).select(settling.leg_outcome(*[F.col(c) for c in ("market", "side", "line", "h", "a", "final", "state", "shots", "box")])).collect()


def test_slips(spark):
    slips = spark.createDataFrame([(k, 10.0, p, b, "OPEN", None) for k, (p, b) in enumerate([(264, False), (300, False), (300, True), (264, False), (264, False), (264, True), (-110, False), (264, False), (500, False)])] + [(99, 10.0, 100, False, "WON", 20.0)], "slip_id int, stake double, price int, is_bonus boolean, status string, payout double")
    legs = {
        0: [("WIN", -110), ("WIN", -110)], 1: [("WIN", -110), ("PUSH", -110)], 2: [("WIN", None), ("WIN", None)], 3: [("LOSS", None), (None, None)], 4: [("WIN", -110), (None, -110)], 5: [("PUSH", -110), ("VOID", -110)], 6: [("VOID", None)], 7: [("WIN", -110), ("VOID", None)],
        99: [("LOSS", 100)],
    }
    df = spark.createDataFrame([(s, n, r, p) for s, ls in legs.items() for n, (r, p) in enumerate(ls)], "slip_id int, leg_no int, result string, price int")
    got = {r["slip_id"]: (r["status"], r["payout"]) for r in settling.slip_results(slips, df).collect()}
    d = 1 + 100 / 110
    assert got[0] == ("WON", round(10 * d * d, 2)) and got[1] == ("WON", round(10 * 4 / d, 2)) and got[2] == ("WON", 30.0)
    assert got[3] == ("LOST", 0.0) and got[4] == ("OPEN", None) and got[5] == ("PUSH", 0.0) and got[6] == ("VOID", 10.0) and got[7] == ("OPEN", None) and got[8] == ("OPEN", None) and got[99] == ("WON", 20.0)


def test_settling_slips_twice(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/slips")
    slips = spark.createDataFrame([(1, 10.0, 100, False, "OPEN", None), (2, 5.0, 100, False, "OPEN", None)], "slip_id int, stake double, price int, is_bonus boolean, status string, payout double")
    legs = spark.createDataFrame([(1, 1, 7, None, "ml", "home", None, 100, None), (2, 1, 8, 3, "prop_sog", "over", 1.5, 100, None)], "slip_id int, leg_no int, game_id int, player_id int, market string, side string, line double, price int, result string")
    v.commit({"slips": slips, "legs": legs})
    games = spark.createDataFrame([(7, 2, 1, "OK", "FINAL"), (8, 2, 1, "OK", "FINAL")], "game_id int, home_score int, away_score int, schedule_state string, game_state string")
    box = spark.createDataFrame([(7, 1, 1)], "game_id int, player_id int, shots int")
    seen = []
    for known in (box, box, box.unionByName(spark.createDataFrame([(8, 3, 4)], box.schema))):
        settling.settle_slips(v, games, known)
        seen.append((rows(v.read("slips").select("slip_id", "status", "payout")), rows(v.read("legs").select("slip_id", "result"))))
    assert seen[0] == seen[1] == ([(1, "WON", 20.0), (2, "OPEN", None)], [(1, "WIN"), (2, None)])
    assert seen[2] == ([(1, "WON", 20.0), (2, "WON", 10.0)], [(1, "WIN"), (2, "WIN")])


def test_area_under_the_curve_is_exact(spark):
    scores = [(k % 2 if k % 5 else 1, 0.5 + (k * 7919 % 1009) * 1e-9) for k in range(900)]
    got = stats.auc(spark.createDataFrame([*scores, (None, 0.5), (1, None)], "y int, p double"), "y", "p").first()["auc"]
    pos, neg = [p for y, p in scores if y], [p for y, p in scores if not y]
    assert got == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / len(pos) / len(neg), abs=1e-12)
    assert stats.auc(spark.createDataFrame([], "y int, p double"), "y", "p").first()["auc"] is None


def test_breaks_between_buckets(spark):
    times = {"a": [0, 10, 3609, 3610, 7210, 7211, 20000], "b": [5], "c": [0, 3601, 7201, 10802]}
    got = rows(pit.breaks(spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k string, s long"), ["k"], "s", 3600))
    want = sorted((k, x, y) for k, ts in times.items() for x, y in zip(ts, ts[1:]) if y - x > 3600)
    assert got == want


def test_margin_weights_reproduce_what_was_seen(spark):
    rnd = random.Random(9)
    games = [(rnd.choice((2.0, 2.8, 3.5)), rnd.choice((2.1, 3.0)), rnd.choice((0, 0, 1, 1, 2, 3, 3, 4, 6))) for _ in range(600)]
    df = spark.createDataFrame(games, "h double, a double, margin int").select(margins.margin_masses(pmf.poisson(F.col("h"), 8), pmf.poisson(F.col("a"), 8)).alias("m"), margins.margin_bucket(F.col("margin"), F.lit(0)).alias("b"))
    total = df.select(F.aggregate("m", F.lit(0.0), lambda s, x: s + x).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    w = margins.fit_margin_weights(df, "m", "b")
    assert w[4] == 1
    for r in margins.fitted_shares(df, "m", "b", w).collect():
        assert r["fitted"] == pytest.approx(r["observed"], abs=1e-9)
    # a margin that was never seen, none at all, none to be relative to
    some = df.filter("b <> 1")
    unseen = margins.fit_margin_weights(some, "m", "b")
    assert unseen[1] == 0 and all(r["fitted"] == pytest.approx(r["observed"], abs=1e-9) for r in margins.fitted_shares(some, "m", "b", unseen).collect())
    with pytest.raises(ValueError, match="no games"):
        margins.fit_margin_weights(df.limit(0), "m", "b")
    with pytest.raises(ValueError, match="relative to"):
        margins.fit_margin_weights(df.filter("b < 4"), "m", "b")


def test_margin_masses_equal_a_plain_grid(spark):
    h, a = [0.1, 0.2, 0.3, 0.15, 0.15, 0.1], [0.3, 0.3, 0.2, 0.1, 0.05, 0.05]
    got = spark.range(1).select(margins.margin_masses(F.array(*map(F.lit, h)), F.array(*map(F.lit, a))).alias("m")).first()["m"]
    want = [sum(x * y for i, x in enumerate(h) for j, y in enumerate(a) if min(abs(i - j), 4) == b) for b in range(5)]
    assert got == pytest.approx(want)


SNAPSHOT = "team string, ts timestamp, game_date date, goalie string, confirmed boolean"


def snapshots(seed):
    rnd = random.Random(seed)
    return [(f"t{k}", dt.datetime(2024, 1, 1 + i // 8, i % 8 * 3, k), dt.date(2024, 1, 1 + i // 8), rnd.choice(["A B", "Á b", "C"]), rnd.random() < 0.4) for i in range(80) for k in range(3)]


def test_stream_of_starters_equals_the_plan_after_a_restart(spark, tmp_path):
    """Files come one by one; the stream is stopped in the middle and goes on from its checkpoint; late rows change nothing."""
    rows_, src = snapshots(1), str(tmp_path / "in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    news.use_rocksdb(spark)
    put = lambda part: spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(src)

    def drain():
        stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(src)
        q = news.starter_news_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    try:
        put(rows_[:70])
        put(rows_[70:130])
        drain()
        put(rows_[130:200])
        put([("t1", dt.datetime(2024, 1, 2), dt.date(2024, 1, 2), "LATE", True)])
        put(rows_[200:])
        drain()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = rows(news.starter_news(spark.createDataFrame(rows_, SNAPSHOT)))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) > 100


def test_news_of_starters(spark):
    at = lambda hour, day, goalie, sure: ("t", T(1, hour), dt.date(2024, 1, day), goalie, sure)
    told = [at(0, 1, "A", False), at(1, 1, "A", True), at(2, 1, "a\u0301", True), at(3, 1, "B", False), at(4, 1, "B", False), at(5, 2, "B", False), at(6, 3, "B", True), at(7, 3, "B", False)]
    got = [(r["ts"].hour, r["kind"], r["goalie"], r["previous"]) for r in news.starter_news(spark.createDataFrame(told, SNAPSHOT)).orderBy("ts").collect()]
    assert got == [(1, news.CONFIRMED, "A", "A"), (3, news.CHANGED, "B", "a\u0301"), (6, news.CONFIRMED, "B", None), (7, news.CHANGED, "B", "B")]
