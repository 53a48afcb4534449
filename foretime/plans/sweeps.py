"""Queries of intervals, request plans, reports and stored shifts on the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.operators import intervals
from foretime.plans import requests, shifts
from foretime.plans.queries import query
from foretime.sources import reports
from foretime.sources.tables import driver_table
from foretime.streaming import news

SPANS = "spans AS (SELECT user_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS s, epoch(date_trunc('second', ts))::BIGINT + floor(value * 40)::BIGINT AS e FROM events)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return driver_table(spark, d, "events").select("user_id", "event_type", s.alias("start"), (s + F.floor(F.col("value") * 40)).alias("end"))


@query(f"""WITH {SPANS}, open AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS o FROM spans WHERE s < e
), runs AS (SELECT *, sum(o::INT) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM open)
SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS parts FROM runs GROUP BY user_id, run""")
def merged_intervals(spark, d):
    return intervals.merged(_spans(spark, d), ["user_id"])


@query(f"""WITH {SPANS}, seconds AS (SELECT DISTINCT user_id, event_type IN ('click', 'view') AS a, unnest(range(s, e)) AS t FROM spans),
each AS (SELECT user_id, t, bool_or(a) AS a, bool_or(NOT a) AS b FROM seconds GROUP BY user_id, t)
SELECT user_id, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM each GROUP BY user_id""")
def source_agreement(spark, d):
    """Seconds on which two sources of intervals agree and disagree; the SQL expands every second."""
    spans, a = _spans(spark, d), F.col("event_type").isin("click", "view")
    return intervals.agreement(spans.filter(a), spans.filter(~a), ["user_id"])


@query(f"""WITH RECURSIVE {SPANS}, chosen AS (
  SELECT user_id, min(e) AS "at" FROM spans WHERE s <= e GROUP BY user_id
  UNION ALL
  SELECT c.user_id, (SELECT min(e) FROM spans x WHERE x.user_id = c.user_id AND x.s > c."at" AND x.s <= x.e) FROM chosen c WHERE EXISTS (SELECT 1 FROM spans x WHERE x.user_id = c.user_id AND x.s > c."at" AND x.s <= x.e)
)
SELECT c.user_id, c."at", (SELECT count(*) FROM spans x WHERE x.user_id = c.user_id AND x.s <= c."at" AND x.e >= c."at" AND NOT EXISTS (SELECT 1 FROM chosen o WHERE o.user_id = c.user_id AND o."at" > c."at" AND o."at" <= x.e)) AS met FROM chosen c""")
def fewest_fetches(spark, d):
    """The fewest instants that meet every window."""
    return intervals.fewest_instants(_spans(spark, d), ["user_id"])


STARTS = "starts AS (SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderdate AS DATE) AS date, epoch(CAST(o_orderdate AS DATE))::BIGINT + (o_orderkey * 7919) % 86400 AS s, o_orderkey AS k FROM orders WHERE o_orderkey % 10 > 0)"
CLOSE = f"""{STARTS}, firsts AS (
  SELECT season, date, min(s) AS f FROM starts GROUP BY season, date
  UNION ALL
  SELECT c.season, c.date, (SELECT min(s) FROM starts x WHERE x.season = c.season AND x.date = c.date AND x.s > c.f + 4500) FROM firsts c WHERE EXISTS (SELECT 1 FROM starts x WHERE x.season = c.season AND x.date = c.date AND x.s > c.f + 4500)
), close AS (SELECT c.season, c.date, c.f - 600 AS "at", count(*) AS n_games, 'close' AS purpose FROM firsts c JOIN starts x ON x.season = c.season AND x.date = c.date AND x.s BETWEEN c.f AND c.f + 4500 GROUP BY c.season, c.date, c.f),
fetches AS (SELECT s - 3600 AS snapshot, s - 500 * (k % 5) AS next_snapshot, CASE WHEN k % 3 = 0 THEN s - 600 END AS requested, CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM starts WHERE k % 4 = 0 AND k % 7 > 0)"""


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Games with a start, but for every tenth, and the fetches that count as bought."""
    k = F.col("o_orderkey")
    s = F.unix_seconds(F.to_date("o_orderdate").cast("timestamp")) + F.pmod(k * 7919, F.lit(86400))
    o = driver_table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("date"), k.alias("k"), F.when(F.pmod(k, F.lit(10)) > 0, F.timestamp_seconds(s)).alias("start"))
    at = F.unix_seconds("start")
    fetches = o.filter("k % 4 = 0 AND start IS NOT NULL").select(
        (at - 3600).alias("snapshot"), (at - 500 * F.pmod("k", F.lit(5))).alias("next_snapshot"), F.when(F.pmod("k", F.lit(3)) == 0, at - 600).alias("requested"), F.when(F.pmod("k", F.lit(7)) == 0, "error").otherwise("ok").alias("status"), F.lit("h2h, totals").alias("markets"), F.lit("x").alias("bookmakers")
    )
    return requests.planned(o, "close"), requests.covering(fetches, "totals")


@query(f"""WITH RECURSIVE {CLOSE}
SELECT season, "at", n_games, purpose, EXISTS (SELECT 1 FROM fetches f WHERE f.requested = "at" OR (f.snapshot <= "at" AND "at" < f.next_snapshot)) AS bought FROM close""")
def planned_requests(spark, d):
    """A close request for each cluster of starts, and whether an earlier fetch has it."""
    return requests.with_coverage(*_plan(spark, d)).drop("date")


@query(f"""WITH RECURSIVE {CLOSE}, marked AS (SELECT *, EXISTS (SELECT 1 FROM fetches f WHERE f.requested = "at" OR (f.snapshot <= "at" AND "at" < f.next_snapshot)) AS bought FROM close)
SELECT purpose, season, count(*) AS snapshots, count(DISTINCT date) AS days, CAST(sum(n_games) AS BIGINT) AS games, count(*) FILTER (WHERE bought) AS bought, count(*) FILTER (WHERE NOT bought) * 20 AS credits FROM marked GROUP BY purpose, season""")
def request_costs(spark, d):
    return requests.described(requests.with_coverage(*_plan(spark, d)), "h2h,totals")


@query(f"""WITH RECURSIVE {CLOSE}, numbered AS (SELECT season, date, "at", row_number() OVER (PARTITION BY season ORDER BY date, "at") - 1 AS i FROM close)
SELECT season, "at", CAST(row_number() OVER (PARTITION BY season ORDER BY list_reduce(list_prepend(0::BIGINT, range(31)), lambda acc, b: acc + ((i >> b) & 1) * (1::BIGINT << (30 - b)))) - 1 AS INT) AS place FROM numbered""")
def spread_requests(spark, d):
    """Requests in an order of which every beginning is spread over the season."""
    return requests.ordered(_plan(spark, d)[0]).select("season", "at", "place")


SHIFTS = """shifts AS (
  SELECT o_custkey AS game_id, l_suppkey AS player_id, l_linenumber AS period, l_partkey % 20 * 30 AS start, ['H', 'A', 'X'][l_suppkey % 3 + 1] AS team, l_orderkey * 10 + l_linenumber AS shift_id, CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS BIGINT) END AS duration FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), sides AS (SELECT c_custkey AS game_id, CASE WHEN c_custkey % 7 > 0 THEN 'H' END AS home, CASE WHEN c_custkey % 7 > 0 THEN 'A' END AS away FROM customer
), ice AS (SELECT game_id, player_id, CAST(sum(coalesce(duration, 0)) + (player_id * 7 + game_id) % 41 - 5 AS BIGINT) AS toi FROM shifts WHERE team <> 'X' AND game_id % 5 > 0 GROUP BY game_id, player_id)"""


def _stored_shifts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shifts, games and ice time."""
    o, li = driver_table(spark, d, "orders"), driver_table(spark, d, "lineitem")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("game_id"), F.col("l_suppkey").alias("player_id"), F.col("l_linenumber").alias("period"), (F.pmod("l_partkey", F.lit(20)) * 30).alias("start"), F.element_at(F.array(F.lit("H"), F.lit("A"), F.lit("X")), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int")).alias("team"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("shift_id"), F.lit(None).cast("long").alias("end"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("long")).alias("duration"),
    )
    ours = F.pmod("c_custkey", F.lit(7)) > 0
    games = driver_table(spark, d, "customer").select(F.col("c_custkey").alias("game_id"), F.when(ours, "H").alias("home"), F.when(ours, "A").alias("away"))
    ice = rows.filter("team <> 'X' AND game_id % 5 > 0").groupBy("game_id", "player_id").agg(F.sum(F.coalesce("duration", F.lit(0))).alias("s"))
    ice = ice.select("game_id", "player_id", (F.col("s") + F.pmod(F.col("player_id") * 7 + F.col("game_id"), F.lit(41)) - 5).alias("toi_seconds"))
    return rows, games, ice


@query(f"""WITH {SHIFTS}, fated AS (
  SELECT s.*, home IS NOT NULL AND team NOT IN (home, away) AS wrong FROM shifts s JOIN sides USING (game_id)
), ranked AS (SELECT *, NOT wrong AND row_number() OVER (PARTITION BY game_id, wrong, player_id, period, start ORDER BY shift_id, duration) > 1 AS repeated FROM fated
), by_game AS (SELECT game_id, count(*) FILTER (WHERE NOT wrong AND NOT repeated) AS n_shifts, count(DISTINCT player_id) FILTER (WHERE NOT wrong AND NOT repeated) AS n_players, count(*) FILTER (WHERE wrong) AS wrong_team, count(*) FILTER (WHERE repeated) AS repeated FROM ranked GROUP BY game_id
), off AS (SELECT ice.game_id, ice.player_id, toi, coalesce(secs, 0) AS secs, abs(coalesce(secs, 0) - toi) AS gap FROM ice LEFT JOIN (SELECT game_id, player_id, CAST(sum(coalesce(duration, 0)) AS BIGINT) AS secs FROM ranked WHERE NOT wrong AND NOT repeated GROUP BY game_id, player_id) USING (game_id, player_id) WHERE toi > 0
), worst AS (SELECT game_id, count(*) FILTER (WHERE gap > 20) AS n_off, max(row(gap, player_id, secs, toi)) FILTER (WHERE gap > 20) AS w FROM off GROUP BY game_id
), done AS (SELECT game_id, coalesce(n_shifts, 0) AS n_shifts, coalesce(n_players, 0) AS n_players, coalesce(wrong_team, 0) AS wrong_team, coalesce(repeated, 0) AS repeated, n_off, w, coalesce(n_shifts >= 20 AND n_players >= 12, false) AS is_full FROM sides LEFT JOIN by_game USING (game_id) LEFT JOIN worst USING (game_id))
SELECT game_id, CASE WHEN n_shifts = 0 THEN 'empty' WHEN NOT is_full THEN 'partial' WHEN n_off IS NULL OR n_off > 0 THEN 'suspect' ELSE 'ok' END AS status, n_shifts, n_players, wrong_team, repeated, CASE WHEN is_full THEN n_off END AS n_off, CASE WHEN is_full THEN w[2] END AS worst_player, CASE WHEN is_full THEN w[3] END AS worst_shifts, CASE WHEN is_full THEN w[4] END AS worst_ice FROM done""")
def shift_verdicts(spark, d):
    """Every game's shifts judged, without rows of other sides and repeated ones."""
    rows, games, ice = _stored_shifts(spark, d)
    return shifts.judged(rows, games, ice, 20, 12, 20)


@query("""
WITH li AS (SELECT l_orderkey AS game_id, l_suppkey % 90 AS sweater, l_linenumber AS n, l_partkey % 20 * 60 + l_suppkey % 60 AS start, CAST(l_quantity AS INT) AS len, CASE WHEN l_linenumber % 5 = 0 THEN 4 ELSE l_linenumber % 5 END AS p FROM lineitem),
numbered AS (SELECT *, row_number() OVER (PARTITION BY game_id, sweater, p, start ORDER BY n DESC, len DESC) AS k FROM li)
SELECT game_id, CASE WHEN sweater % 9 > 0 THEN sweater + 8470000 END AS player_id, CAST(p AS INT) AS period, CAST(start AS INT) AS start, CAST(start + len AS INT) AS "end", CAST(len AS INT) AS duration, CAST(n AS INT) AS shift_number, CAST(sweater AS INT) AS sweater, CASE WHEN sweater % 9 > 0 THEN 'H&H' END AS team
FROM numbered WHERE k = 1 OR sweater % 9 = 0""")
def report_shifts(spark, d):
    """Reports and box scores made of orders, as pages and JSON, and read again; every ninth sweater isn't in the box score."""
    s = lambda c: c.cast("string")
    clock = lambda c: F.concat(s(F.floor(c / 60)), F.lit(":"), F.lpad(s(F.pmod(c, F.lit(60))), 2, "0"))
    cell = lambda c: F.concat(F.lit('<td class="x">'), c, F.lit("</td>"))
    both = lambda c: F.concat(clock(c), F.lit(" / "), clock(F.greatest(F.lit(1200) - c, F.lit(0))))

    def row(x: Column) -> Column:
        n, start, length = x["n"], x["start"], x["length"]
        period = F.pmod(n, F.lit(5))
        return F.concat(F.lit("<tr>"), cell(s(n)), cell(F.when(period == 0, "OT").otherwise(s(period))), cell(both(start)), cell(F.concat(F.lit("<b>"), both(start + length), F.lit("</b>&nbsp;"))), cell(clock(length)), F.lit("</tr>"))

    # lines meet by game once, and their columns alone travel
    start = F.pmod("l_partkey", F.lit(20)) * 60 + F.pmod("l_suppkey", F.lit(60))
    shift = F.struct(F.pmod("l_suppkey", F.lit(90)).alias("sweater"), F.col("l_linenumber").alias("n"), start.alias("start"), F.col("l_quantity").cast("int").alias("length"))
    games = driver_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(F.sort_array(F.collect_list(shift)).alias("shifts"))
    games = games.withColumn("worn", F.array_distinct("shifts.sweater"))
    totals = "<tr><td>1</td><td>2</td><td>30:00</td><td>x</td><td>0:40</td></tr>"
    block = lambda w: F.concat(F.lit('<td class="playerHeading + border">'), s(w), F.lit(" DOE, JO</td><table>"), F.array_join(F.transform(F.filter("shifts", lambda x: x["sweater"] == w), row), "\n"), F.lit(totals + "</table>"))
    pages = games.select("game_id", F.lit("H").alias("side"), F.concat(F.lit("<html>"), F.array_join(F.transform("worn", block), "")).alias("html"))
    player = lambda w: F.struct((w + 8470000).alias("playerId"), w.alias("sweaterNumber"))
    body = F.struct(F.struct(F.lit("H&H").alias("abbrev")).alias("homeTeam"), F.struct(F.struct(F.transform(F.filter("worn", lambda w: F.pmod(w, F.lit(9)) > 0), player).alias("forwards")).alias("homeTeam")).alias("playerByGameStats"))
    boxes = games.select("game_id", F.to_json(body).alias("body"))
    return reports.player_shifts(pages, boxes).select("game_id", "player_id", "period", "start", "end", "duration", "shift_number", F.col("sweater").cast("int").alias("sweater"), "team")


@query("""
WITH s AS (SELECT user_id % 40 AS team, ts, CAST(ts AS DATE) + CAST(event_id % 2 AS INT) AS game_date, event_type AS goalie, value > 10 AS confirmed, event_id FROM events),
b AS (SELECT *, lag(game_date) OVER w AS pd, lag(goalie) OVER w AS pg, lag(confirmed) OVER w AS pc FROM s WINDOW w AS (PARTITION BY team ORDER BY ts)),
k AS (SELECT *, coalesce(pd = game_date, false) AS same FROM b)
SELECT team, epoch_us(ts) AS at_us, CASE WHEN NOT same THEN 'STARTER_CONFIRMED' WHEN pg <> goalie THEN 'STARTER_CHANGED' WHEN confirmed THEN 'STARTER_CONFIRMED' ELSE 'STARTER_CHANGED' END AS kind, goalie, CASE WHEN same THEN pg END AS previous
FROM k WHERE CASE WHEN NOT same THEN confirmed ELSE pg <> goalie OR confirmed <> pc END""")
def starter_news(spark, d):
    """News of who starts, from snapshots in order; the stream of streaming/news.py gives the same."""
    e = driver_table(spark, d, "events").select(F.pmod("user_id", F.lit(40)).alias("team"), F.col("ts").cast("timestamp").alias("ts"), F.date_add(F.to_date("ts"), F.pmod("event_id", F.lit(2)).cast("int")).alias("game_date"), F.concat(F.upper("event_type")).alias("goalie"), (F.col("value") > 10).alias("confirmed"))
    return news.starter_news(e).select("team", F.unix_micros("ts").alias("at_us"), "kind", F.lower("goalie").alias("goalie"), F.lower("previous").alias("previous"))


_FETCHES = "fetches AS (SELECT c_custkey AS game_id, ['ok', 'ok', 'suspect', 'partial', 'empty', 'error', 'ok'][c_custkey % 7 + 1] AS status, CASE WHEN c_custkey % 4 = 0 THEN 'html' ELSE 'api' END AS source, c_custkey % 50 AS n_shifts FROM customer WHERE c_custkey % 11 > 0)"


@query(f"""WITH {SHIFTS}, {_FETCHES}, g AS (SELECT game_id, home, away, c_nationkey % 4 AS season FROM sides JOIN customer ON c_custkey = game_id),
box AS (SELECT game_id, player_id, toi FROM ice WHERE toi > 0), okbox AS (SELECT box.*, secs, s.player_id IS NULL AS gone FROM box JOIN fetches f ON f.game_id = box.game_id AND f.status = 'ok' LEFT JOIN (SELECT game_id, player_id, sum(duration) AS secs FROM shifts GROUP BY game_id, player_id) s ON s.game_id = box.game_id AND s.player_id = box.player_id),
gap AS (SELECT season, abs(secs - toi) AS gap FROM okbox JOIN g USING (game_id) WHERE player_id % 2 = 0 AND secs IS NOT NULL), stats AS (SELECT season, median(gap) AS median_gap, count(*) AS checked, count(*) FILTER (WHERE gap > 5) AS over_5, count(*) FILTER (WHERE gap > 20) AS over_tolerance FROM gap GROUP BY season),
miss AS (SELECT game_id, count(*) AS n FROM okbox WHERE gone GROUP BY game_id), rep AS (SELECT game_id, sum(n - 1) AS n FROM (SELECT game_id, count(*) AS n FROM shifts GROUP BY game_id, player_id, period, start) GROUP BY game_id), wrong AS (SELECT s.game_id, count(*) AS n FROM shifts s JOIN g USING (game_id) WHERE s.team IS DISTINCT FROM g.home AND s.team IS DISTINCT FROM g.away GROUP BY s.game_id)
SELECT g.season, count(*) AS finished, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'ok' AND source = 'html') AS ok_from_html, count(*) FILTER (WHERE status = 'suspect') AS suspect, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'empty') AS "empty", count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE f.game_id IS NULL) AS not_fetched,
  coalesce(sum(n_shifts), 0)::BIGINT AS shifts, coalesce(sum(miss.n), 0)::BIGINT AS players_without_shifts, coalesce(sum(rep.n), 0)::BIGINT AS repeated_rows, coalesce(sum(wrong.n), 0)::BIGINT AS wrong_team_rows, any_value(median_gap) AS median_gap, any_value(checked) AS checked, any_value(over_5) AS over_5, any_value(over_tolerance) AS over_tolerance
FROM g LEFT JOIN fetches f ON f.game_id = g.game_id LEFT JOIN miss ON miss.game_id = g.game_id LEFT JOIN rep ON rep.game_id = g.game_id LEFT JOIN wrong ON wrong.game_id = g.game_id LEFT JOIN stats ON stats.season = g.season GROUP BY g.season""")
def shift_coverage(spark, d):
    """How complete stored shifts are, season by season."""
    rows, games, ice = _stored_shifts(spark, d)
    k = F.col("c_custkey")
    c = driver_table(spark, d, "customer").select(k.alias("game_id"), F.pmod("c_nationkey", F.lit(4)).alias("season"), F.element_at(F.array(*map(F.lit, ("ok", "ok", "suspect", "partial", "empty", "error", "ok"))), (F.pmod(k, F.lit(7)) + 1).cast("int")).alias("status"), F.when(F.pmod(k, F.lit(4)) == 0, "html").otherwise("api").alias("source"), F.pmod(k, F.lit(50)).alias("n_shifts"))
    games = games.join(c.select("game_id", "season"), "game_id")
    return shifts.coverage(games, c.filter("game_id % 11 > 0"), rows, ice.withColumn("skater", F.pmod("player_id", F.lit(2)) == 0), 20)
