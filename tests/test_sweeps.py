"""Intervals, request plans, reports and stored shifts on small frames."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from foretime.operators import intervals, sequential
from foretime.plans import requests, shifts
from foretime.sources import reports


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, start long, end long")


def made(seed, n=60):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), s := rnd.randint(0, 120), s + rnd.randint(-2, 15)) for _ in range(n)]


def seconds(rows, k):
    return {t for key, s, e in rows if key == k for t in range(s, e)}


def test_merged_intervals_cover_the_same_seconds(spark):
    rows = made(1)
    out = [tuple(r)[:3] for r in intervals.merged(spans(spark, rows), ["k"]).orderBy("k", "start").collect()]
    for k in "ab":
        own = [r for r in out if r[0] == k]
        assert seconds(own, k) == seconds(rows, k)
        assert all(x[2] < y[1] for x, y in zip(own, own[1:]))  # touching ones are merged too
    assert intervals.merged(spans(spark, [("a", 5, 5), ("a", 7, 3)]), ["k"]).count() == 0


def test_agreement_counts_every_second(spark):
    a, b = made(2), [*made(3), ("c", 0, 4)]
    got = {r["k"]: tuple(r)[1:] for r in intervals.agreement(spans(spark, a), spans(spark, b), ["k"]).collect()}
    for k in "abc":
        x, y = seconds(a, k), seconds(b, k)
        assert got[k] == (len(x & y), len(x - y), len(y - x))


def test_fewest_instants_meet_all_and_are_fewest(spark):
    rnd = random.Random(6)
    rows = [(f"k{j}", s := rnd.randint(0, 30), s + rnd.randint(0, 9)) for j in range(12) for _ in range(7)]
    got = intervals.fewest_instants(spans(spark, rows).repartition(3), ["k"]).collect()
    for j in range(12):
        own, at = [r for r in rows if r[0] == f"k{j}"], [r["at"] for r in got if r["k"] == f"k{j}"]
        assert all(any(s <= t <= e for t in at) for _, s, e in own)
        ends = sorted({e for _, _, e in own})
        fewer = itertools.combinations(ends, len(at) - 1)  # an optimal choice may be moved to ends
        assert not any(all(any(s <= t <= e for t in c) for _, s, e in own) for c in fewer)
        assert sum(r["met"] for r in got if r["k"] == f"k{j}") == len(own)


def test_intervals_that_end_where_an_instant_opens_are_counted_there(spark):
    got = intervals.fewest_instants(spans(spark, [("a", 0, 3), ("a", 2, 5), ("a", 4, 5)]), ["k"]).collect()
    assert sorted(tuple(r) for r in got) == [("a", 3, 1), ("a", 5, 2)]


def games(spark, rows):
    return spark.createDataFrame([(2024, dt.date.fromisoformat(d), dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc) if s else None) for d, s in rows], "season int, date date, start timestamp")


def seconds_of(text):
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp())


def test_planned_requests(spark):
    g = games(spark, [("2024-01-10", "2024-01-11 00:00:00"), ("2024-01-10", "2024-01-11 01:15:00"), ("2024-01-10", "2024-01-11 01:16:00"), ("2024-01-10", None), ("2024-07-01", "2024-07-01 15:00:00")])
    close = {(r["at"], r["n_games"]) for r in requests.planned(g, "close").collect()}
    assert close == {(seconds_of("2024-01-10 23:50:00"), 2), (seconds_of("2024-01-11 01:06:00"), 1), (seconds_of("2024-07-01 14:50:00"), 1)}
    # ten o'clock in Chicago is 16:00 UTC in winter, 15:00 in summer: a game that starts then isn't after it
    assert [(r["at"], r["n_games"]) for r in requests.planned(g, "morning").collect()] == [(seconds_of("2024-01-10 16:00:00"), 3)]


def test_bought_requests_are_known_across_days(spark):
    at = [100, 86400 * 3 + 5, 86400 * 3 + 50, 86400 * 9]
    plan = spark.createDataFrame([(2024, "close", dt.date(2024, 1, 1), a, 2) for a in at], "season int, purpose string, date date, at long, n_games int")
    fetches = spark.createDataFrame([(None, 50, 86400 * 3 + 50), (86400 * 9, None, None), (7, 86400 * 20, 86400 * 30)], "requested long, snapshot long, next_snapshot long")
    got = requests.with_coverage(plan, fetches)
    assert {r["at"]: r["bought"] for r in got.collect()} == dict(zip(at, (True, True, False, True)))
    assert tuple(requests.described(got, "h2h, totals").first()) == ("close", 2024, 4, 1, 8, 3, 20)
    assert not any(r["bought"] for r in requests.with_coverage(plan, fetches.limit(0)).collect())


def test_covering_fetches_hold_every_market(spark):
    df = spark.createDataFrame([("ok", "h2h,totals", "a,b"), ("error", "h2h", "a"), ("empty", " totals ,h2h", "b"), ("ok", None, "a")], "status string, markets string, bookmakers string")
    assert requests.covering(df, "h2h").count() == 2 and requests.covering(df, "h2h,spreads").count() == 0 and requests.covering(df, "totals", "b").count() == 1


def test_requests_in_spread_order(spark):
    for n in (1, 2, 5, 8, 13):
        plan = spark.createDataFrame([("close", 2024, dt.date(2024, 1, 1), k) for k in range(n)], "purpose string, season int, date date, at long")
        bits = max(1, (n - 1).bit_length())
        want = sorted(range(n), key=lambda i: int(format(i, f"0{bits}b")[::-1], 2))
        assert [r["at"] for r in requests.ordered(plan).orderBy("place").collect()] == want


PAGE = """<td align="center" class="playerHeading + border" colspan="8">9 O&#39;HARA, J</td>
<tr class="x"><td>1</td><td>1</td><td>0:10 / 19:50</td><td>0:50 / 19:10</td><td>00:40</td><td>&nbsp;</td></tr>
<tr><td>2</td><td>OT</td><td>1:00 / 4:00</td><td>1:30 / 3:30</td><td></td></tr>
<tr><td>3</td><td>2</td><td>5:00&nbsp;/&nbsp;15:00</td><td>-</td><td>0:20</td></tr>
<tr><td>TOT</td><td>x</td><td>12:00</td><td>1</td><td>0:40</td></tr><tr><td>few</td></tr>
<td CLASS="playerHeading">77 DOE</td><TR><TD>1</TD><TD>1</TD><TD>0:00 / 20:00</TD><TD>0:45 / 19:15</TD><TD>0:45</TD></TR>"""


def test_reports_are_read_row_by_row(spark):
    pages = spark.createDataFrame([(1, "H", PAGE), (2, "V", ""), (3, "V", None), (4, "H", "<html>nothing</html>")], "game_id int, side string, html string")
    got = [tuple(r) for r in reports.report_shifts(pages, ["game_id", "side"]).orderBy("sweater", "period").collect()]
    assert got == [(1, "H", 9, 1, 1, 10, 50, 40), (1, "H", 9, 3, 2, 300, None, 20), (1, "H", 9, 2, 4, 60, 90, 30), (1, "H", 77, 1, 1, 0, 45, 45)]
    box = '{"homeTeam": {"abbrev": "AAA"}, "playerByGameStats": {"homeTeam": {"forwards": [{"playerId": 5, "sweaterNumber": 9}, {"playerId": 6}], "defense": [{"playerId": 7, "sweaterNumber": 9}]}}}'
    boxes = spark.createDataFrame([(1, box), (4, "{}")], "game_id int, body string")
    assert [tuple(r) for r in reports.sweaters(boxes).collect()] == [(1, "H", 9, 7, "AAA")]
    both = reports.player_shifts(pages, boxes).collect()
    assert sorted((r["player_id"] or 0, r["sweater"], r["team"] or "") for r in both) == [(0, 77, ""), (7, 9, "AAA"), (7, 9, "AAA"), (7, 9, "AAA")]


def shift_frames(spark):
    row = lambda g, i, p, start, team="H", dur=40: (g, i, p, 1, start, team, start + 40, dur)
    rows = [row(1, 10 * p + k, p, 50 * k) for p in range(3) for k in range(4)]
    rows += [row(1, 99, 0, 0), row(1, 100, 1, 0, "X"), (1, None, 2, 1, 0, "H", 40, 40)]  # repeated, foreign, repeated without an id
    rows += [row(2, 1, 5, 0), row(4, 1, 5, 0, "Z")]
    s = spark.createDataFrame(rows, "game_id int, shift_id int, player_id int, period int, start int, team string, end int, duration int")
    g = spark.createDataFrame([(1, "H", "A"), (2, "H", "A"), (3, "H", "A"), (4, None, None)], "game_id int, home string, away string")
    return s, g


def test_games_are_judged_by_size_and_ice_time(spark):
    s, g = shift_frames(spark)
    fates = {(r["shift_id"], r["player_id"]): r["fate"] for r in shifts.cleaned(s, g).filter("game_id = 1").collect()}
    assert fates[(99, 0)] == "repeated" and fates[(100, 1)] == "wrong_team" and fates[(None, 2)] == "repeated" and fates[(0, 0)] == "kept"
    ice = lambda *toi: spark.createDataFrame([(1, p, t) for p, t in enumerate(toi)], "game_id int, player_id int, toi_seconds int")
    run = lambda ice: {r["game_id"]: tuple(r)[1:] for r in shifts.judged(s, g, ice, 10, 3, 20).collect()}
    assert run(ice(160, 150, 180))[1] == ("ok", 12, 3, 1, 2, 0, None, None, None)
    assert run(ice(160, 100, 300, 60))[1] == ("suspect", 12, 3, 1, 2, 3, 2, 160, 300)
    assert run(ice())[1][0] == "suspect"
    rest = run(ice(160))
    assert rest[2][:2] == ("partial", 1) and rest[3][:2] == ("empty", 0) and rest[4][:2] == ("partial", 1)


def test_a_recheck_keeps_what_it_does_not_look_at(spark):
    s, g = shift_frames(spark)
    fetches = spark.createDataFrame([(1, "ok", "api"), (2, "error", "api"), (3, "suspect", "html")], "game_id int, status string, source string")
    ice = spark.createDataFrame([(1, p, 160) for p in range(3)], "game_id int, player_id int, toi_seconds int")
    kept, status = shifts.rechecked(s, g, ice, fetches, least_shifts=10, least_players=3, tolerance=20)
    assert kept.filter("game_id = 1").count() == 12 and kept.filter("game_id <> 1").count() == 2
    assert {r["game_id"]: (r["status"], r["changed"]) for r in status.collect()} == {1: ("ok", False), 2: ("error", None), 3: ("empty", True)}


def test_caps_begin_anew_each_day_whatever_the_batches(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 30) or None, rnd.randint(0, 5), round(rnd.random(), 3), rnd.choice((0.01, 0.02, 0.03)), k) for k in range(900)]
    df = spark.createDataFrame(rows, "day int, item int, edge double, stake double, id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["id"]: r["kept"] for r in sequential.allocate(df, ["day"], "item", "edge", "stake", [-F.col("edge"), F.col("id")]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for day in {r[0] for r in rows}:
        used, taken = 0.0, {}
        for _, item, _, stake, k in sorted((r for r in rows if r[0] == day), key=lambda r: (-r[2], r[4])):
            n, on = taken.get(item, (0, 0.0))
            fits = used + stake <= 0.1 + 1e-9 and on + stake <= 0.04 + 1e-9 and n < 3
            if fits:
                used, taken[item] = used + stake, (n + 1, on + stake)
            assert got[k] == fits


def test_pages_are_read_once_and_the_highest_number_stays(spark):
    """One pass of the row generator; of a player's shifts with one start the highest number stays, unknown sweaters keep all, and odd clocks are NULL."""
    cell = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    two = cell(1, 1, "0:10 / 19:50", "0:50 / 19:10", "0:40") + cell(3, 1, "0:10 / 19:50", "0:30 / 19:30", "x") + cell("", 1, "0:10 / 19:50", "0:55 / 19:05", "")
    page = "".join(f'<td class="playerHeading">{w} A</td>{two}' for w in (9, 77))
    pages = spark.createDataFrame([(1, "H", page), (1, "V", page), (2, None, page)], "game_id int, side string, html string")
    box = '{"homeTeam": {"abbrev": "AAA"}, "playerByGameStats": {"homeTeam": {"forwards": [{"playerId": 5, "sweaterNumber": 9}]}}}'
    df = reports.player_shifts(pages, spark.createDataFrame([(1, box), (None, box)], "game_id int, body string"))
    got = [tuple(r) for r in df.select("game_id", "side", "sweater", "player_id", "shift_number", "start", "end", "duration").collect()]
    assert len(got) == 1 + 3 + 6 + 6 and [r for r in got if r[3]] == [(1, "H", 9, 5, 3, 10, 30, 20)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ReportRows") == 1 and "Union" not in plan


def test_verdicts_are_dealt_by_game_over_all_partitions(spark):
    """Every shuffle of shifts goes by game in the set number of partitions, so a task's part doesn't follow a size target; a player with two ice times counts twice, one without shifts and a NULL player have none to meet."""
    s, g = shift_frames(spark)
    ice = spark.createDataFrame([(1, 0, 100), (1, 0, 5), (1, 7, 90), (1, None, 60), (2, 1, 0)], "game_id int, player_id int, toi_seconds int")
    df = shifts.judged(s, g, ice, 10, 3, 20)
    got = {r["game_id"]: r for r in df.collect()}
    assert (got[1]["n_off"], got[1]["worst_player"], got[1]["worst_shifts"], got[1]["worst_ice"]) == (4, 0, 160, 5) and got[2]["n_off"] is None
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
