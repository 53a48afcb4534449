"""Queries of market snapshots, change detection, parsing and checks on the driver's tables, and the same in SQL.

Events stand for quotes: user for item, event type for venue; lineitems for the members of an order's units.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foretime.functions import guards, prices, text
from foretime.operators import ledger, markets, stats
from foretime.plans import features
from foretime.plans.pricing import BETS, DECIMAL, IMPLIED, _bets
from foretime.plans.queries import GAMES, games, query, r6
from foretime.sources.tables import driver_table
from foretime.streaming import changes

QUOTES = """
quotes AS (SELECT event_id, user_id % 40 AS item, event_type AS venue, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, CASE WHEN event_id % 2 = 0 THEN -(105 + event_id % 150) ELSE 100 + event_id % 120 END AS home,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN -(101 + event_id % 80) ELSE 101 + event_id % 140 END AS away, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 5.5 + event_id % 4 / 2.0 END AS line, 4.0 + event_id % 9 / 2.0 AS total FROM events)"""


def _quotes(spark, d):
    k = F.col("event_id")
    mod = lambda n: F.pmod(k, F.lit(n))
    return driver_table(spark, d, "events").select(
        k, F.pmod("user_id", F.lit(40)).alias("item"), F.col("event_type").alias("venue"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.when(mod(2) == 0, -(105 + mod(150))).otherwise(100 + mod(120)).alias("home"),
        F.when(mod(7) == 0, None).when(mod(3) == 0, -(101 + mod(80))).otherwise(101 + mod(140)).alias("away"), F.when(mod(5) != 0, 5.5 + mod(4) / 2).alias("line"), (4.0 + mod(9) / 2).alias("total"),
    )


#: A fixed instant inside the driver's events, in seconds and as text.
ASOF, ASOF_TEXT = 1704931200, "2024-01-11 00:00:00"
IN_PLAY = f"(coalesce(abs(home) >= 1000 OR abs(away) >= 1000, false) OR coalesce({IMPLIED.format('home')} + {IMPLIED.format('away')} < 0.75, false) OR coalesce(total < 5 OR total >= 8, false))"


@query(
    f"""WITH {QUOTES}, recent AS (SELECT item, venue, arg_max(home, (s, event_id)) AS home, arg_max(away, (s, event_id)) AS away FROM quotes WHERE away IS NOT NULL AND item % 3 > 0 AND s BETWEEN {ASOF} - 36000 AND {ASOF} GROUP BY 1, 2),
old AS (SELECT item, venue, arg_max(home, (s, event_id)) AS home, arg_max(away, (s, event_id)) AS away FROM quotes WHERE away IS NOT NULL AND NOT {IN_PLAY} AND s < {ASOF} - 36000 GROUP BY 1, 2)
SELECT * FROM recent UNION ALL SELECT * FROM old WHERE item NOT IN (SELECT item FROM recent)"""
)
def market_with_fallback(spark, d):
    """The latest quotes of ten hours; items without any take an archive."""
    q = _quotes(spark, d).withColumn("ts", F.struct(F.timestamp_seconds("s").alias("t"), "event_id"))
    archive = q.filter((F.col("s") < ASOF - 36000) & F.col("away").isNotNull() & ~markets.in_play(F.col("home"), F.col("away"), F.col("total")))
    archive = archive.groupBy("item", "venue").agg(F.max_by(F.struct("home", "away", "total"), "ts").alias("q")).select("item", "venue", "q.*")
    fresh = _quotes(spark, d).filter(F.pmod("item", F.lit(3)) > 0).withColumn("ts", F.timestamp_micros(F.col("s") * 1000000 + F.pmod("event_id", F.lit(1000000)) * 0))
    fresh = fresh.filter(F.col("away").isNotNull()).groupBy("item", "venue", "ts").agg(F.max_by(F.struct("home", "away"), "event_id").alias("q")).select("item", "venue", "ts", "q.*")
    return markets.latest_with_fallback(fresh, archive, ["item"], "ts", ASOF_TEXT, 10)


@query(
    f"""WITH {QUOTES}, l AS (SELECT item, venue, arg_max(line, (s, event_id)) AS line FROM quotes WHERE line IS NOT NULL AND s BETWEEN {ASOF} - 172800 AND {ASOF} GROUP BY 1, 2)
SELECT item, median(line) AS line FROM l GROUP BY item"""
)
def median_lines(spark, d):
    q = _quotes(spark, d).filter(F.col("line").isNotNull()).groupBy("item", "venue", F.timestamp_seconds("s").alias("ts")).agg(F.max_by("line", "event_id").alias("line"))
    return markets.median_line(q, ["item"], "ts", ASOF_TEXT, 48)


@query(f"""WITH {QUOTES}, t AS (SELECT item, venue, home, round({DECIMAL.format("home")}, 12) AS dec FROM quotes), m AS (SELECT item, max(dec) AS dec FROM t GROUP BY item)
SELECT item, min(home) AS home, array_to_string(list_sort(list(DISTINCT venue)), ',') AS venues FROM t JOIN m USING (item, dec) GROUP BY item""")
def tied_best_prices(spark, d):
    out = markets.tied_best(_quotes(spark, d), ["item"], "home")
    return out.withColumn("venues", F.array_join("venues", ","))


@query(f"""WITH {QUOTES} SELECT event_id, {IN_PLAY} AS in_play, CASE WHEN {IMPLIED.format('home')} + {IMPLIED.format('away')} BETWEEN 1.0 AND 1.2 THEN home END AS home, CASE WHEN {IMPLIED.format('home')} + {IMPLIED.format('away')} BETWEEN 1.0 AND 1.2 THEN away END AS away FROM quotes""")
def quote_checks(spark, d):
    """Quotes that can't be from before the start, and pairs whose implied chances make no market."""
    q = _quotes(spark, d)
    return markets.sane_pair(q.withColumn("in_play", markets.in_play(F.col("home"), F.col("away"), F.col("total"))), "home", "away").select("event_id", "in_play", "home", "away")


@query(
    f"""WITH {QUOTES}, f AS (SELECT item, venue, s, event_id, {IMPLIED.format('home')} / ({IMPLIED.format('home')} + {IMPLIED.format('away')}) AS fair, home FROM quotes WHERE away IS NOT NULL),
b AS (SELECT item, venue, arg_max(fair, (s, event_id)) AS was, arg_max(home, (s, event_id)) AS price FROM f WHERE s < {ASOF} GROUP BY 1, 2), n AS (SELECT item, venue, arg_max(fair, (s, event_id)) AS now, arg_max(home, (s, event_id)) AS price FROM f WHERE s >= {ASOF} GROUP BY 1, 2)
SELECT item, round(max(abs(now - was)), 6) AS move, count(*) AS venues, max(abs(now - was)) >= 0.1 AS moved FROM b JOIN n USING (item, venue) GROUP BY item"""
)
def price_moves(spark, d):
    q = _quotes(spark, d).filter(F.col("away").isNotNull())
    last = lambda x: x.groupBy("item", "venue").agg(F.max_by(F.struct("home", "away"), F.struct("s", "event_id")).alias("q")).select("item", "venue", "q.*")
    out = markets.price_move(last(q.filter(F.col("s") < ASOF)), last(q.filter(F.col("s") >= ASOF)), ["item"], 0.1)
    return out.select("item", r6("move", "move"), "venues", "moved")


SCALE = "(CASE WHEN {0} < 0 THEN {0} + 100 ELSE {0} - 100 END)"


@query(
    f"""WITH {QUOTES}, p AS (SELECT venue, CASE WHEN away IS NULL THEN 'unpaired' WHEN line IS NULL THEN 'line_differs' ELSE 'ok' END AS status, {SCALE.format('home')} - {SCALE.format('away')} AS cents, ({IMPLIED.format('home')} - {IMPLIED.format('away')}) * 100 AS points FROM quotes)
SELECT venue, count(*) FILTER (WHERE status = 'ok') AS paired, count(*) FILTER (WHERE status = 'ok' AND cents = 0) AS identical, round(avg(abs(points)) FILTER (WHERE status = 'ok'), 6) AS mean_points, round(max(abs(points)) FILTER (WHERE status = 'ok'), 6) AS max_points,
  round(avg(abs(cents)) FILTER (WHERE status = 'ok'), 6) AS mean_cents, count(*) FILTER (WHERE status = 'unpaired') AS unpaired, count(*) FILTER (WHERE status = 'line_differs') AS line_differs FROM p GROUP BY venue"""
)
def pair_summary(spark, d):
    """How far two feeds' prices are apart, by venue."""
    status = F.when(F.col("away").isNull(), "unpaired").when(F.col("line").isNull(), "line_differs").otherwise("ok")
    p = _quotes(spark, d).withColumns({"status": status, "cents": prices.cents_apart(F.col("home"), F.col("away")), "points": prices.points_apart(F.col("home"), F.col("away"))})
    out = changes.pair_summary(p, ["venue"])
    return out.select("venue", "paired", "identical", r6("mean_points", "mean_points"), r6("max_points", "max_points"), r6("mean_cents", "mean_cents"), "unpaired", "line_differs")


@query(
    f"""WITH {QUOTES}, l AS (SELECT venue, item, home IS DISTINCT FROM lag(home) OVER w AND lag(event_id) OVER w IS NOT NULL AS moved FROM quotes WINDOW w AS (PARTITION BY venue, item ORDER BY s, event_id)), f AS (SELECT venue, item, count(*) AS snapshots, count(*) FILTER (WHERE moved) AS changes FROM l GROUP BY 1, 2)
SELECT venue, count(*) AS series, CAST(sum(snapshots) AS BIGINT) AS snapshots, CAST(sum(changes) AS BIGINT) AS changes, count(*) FILTER (WHERE changes > 0) AS moved FROM f GROUP BY venue"""
)
def freshness_summary(spark, d):
    series = changes.freshness(_quotes(spark, d), ["venue", "item"], ["s", "event_id"], "s", ["home"])
    return changes.freshness_summary(series, ["venue"])


@query(
    """WITH l AS (SELECT l_orderkey % 50 AS team, l_linenumber AS unit, 'p' || CAST(l_suppkey AS VARCHAR) AS member, CAST(l_shipdate AS DATE) < DATE '1995-06-17' AS old FROM lineitem),
b AS (SELECT DISTINCT team, unit, member FROM l WHERE old), n AS (SELECT DISTINCT team, unit, member FROM l WHERE NOT old AND team IN (SELECT team FROM l WHERE old)),
bu AS (SELECT team, unit, list_sort(list(member)) AS was FROM b WHERE team IN (SELECT team FROM n) GROUP BY 1, 2), nu AS (SELECT team, unit, list_sort(list(member)) AS now FROM n GROUP BY 1, 2)
SELECT team, 'OUT' AS event, member AS what FROM (SELECT DISTINCT team, member FROM b EXCEPT SELECT team, member FROM n) UNION ALL SELECT team, 'IN', member FROM (SELECT DISTINCT team, member FROM n EXCEPT SELECT team, member FROM b)
UNION ALL SELECT coalesce(bu.team, nu.team), 'UNIT', CAST(coalesce(bu.unit, nu.unit) AS VARCHAR) FROM bu FULL JOIN nu ON bu.team = nu.team AND bu.unit = nu.unit WHERE was IS DISTINCT FROM now"""
)
def lineup_changes(spark, d):
    li = driver_table(spark, d, "lineitem").select(F.pmod("l_orderkey", F.lit(50)).alias("team"), F.col("l_linenumber").cast("string").alias("unit"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("member"), (F.to_date("l_shipdate") < F.lit("1995-06-17").cast("date")).alias("old"))
    return changes.lineup_changes(li.filter("old").drop("old"), li.filter("NOT old").drop("old"), "team", "unit", "member")


@query(
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 1440 AS now, 1080 + o_orderkey % 240 AS last_start, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1440 - o_orderkey % 29 END AS last_run, o_orderkey % 9 > 0 AS games FROM orders)
SELECT k, games AND now >= 480 AND now <= last_start AND (last_run IS NULL OR now - last_run >= 14) AS due FROM x"""
)
def run_windows(spark, d):
    """Whether a scheduled run should work at a minute of its day."""
    k = F.col("o_orderkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    at = lambda minutes: F.timestamp_seconds(F.lit(1704844800) + minutes * 60)
    o = driver_table(spark, d, "orders")
    last = F.when(mod(9) > 0, at(1080 + mod(240)))
    return o.select(k.alias("k"), changes.run_due(at(mod(1440)), at(F.lit(480)), last, F.when(mod(4) > 0, at(mod(1440) - mod(29)))).alias("due"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN 'bad' ELSE 'KXNHLGAME-' || lpad(CAST(20 + o_orderkey % 7 AS VARCHAR), 2, '0') || ['JAN', 'FEB', 'MAR', 'OCT', 'NOV', 'DEC', 'XXX'][CAST(o_orderkey % 7 + 1 AS INT)] || lpad(CAST(1 + o_orderkey % 31 AS VARCHAR), 2, '0') || 'DETCGY' END AS t FROM orders),
p AS (SELECT *, CASE WHEN length(t) > 10 THEN try_strptime(substr(t, 11, 2) || '-' || substr(t, 13, 3) || '-' || substr(t, 16, 2), '%y-%b-%d') END AS moment FROM x)
SELECT k, CAST(CAST(moment AS DATE) AS VARCHAR) AS day, CASE WHEN moment IS NOT NULL THEN substr(t, 18) END AS teams, CASE WHEN length(t) > 10 THEN 'DET' END AS code FROM p"""
)
def event_tickers(spark, d):
    k = F.col("o_orderkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    month = F.element_at(F.array(*[F.lit(m) for m in ("JAN", "FEB", "MAR", "OCT", "NOV", "DEC", "XXX")]), (mod(7) + 1).cast("int"))
    t = F.when(mod(8) == 0, "bad").otherwise(F.concat(F.lit("KXNHLGAME-"), two(20 + mod(7)), month, two(1 + mod(31)), F.lit("DETCGY")))
    x = driver_table(spark, d, "orders").select(k.alias("k"), t.alias("t"))
    x = x.withColumns({"e": text.event_ticker(F.col("t")), "m": F.when(F.col("t") != "bad", F.concat("t", F.lit("-DET"))).otherwise(F.col("t"))})
    return x.select("k", F.col("e.day").cast("string").alias("day"), F.col("e.teams").alias("teams"), text.market_code(F.col("m")).alias("code"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 75 AS m, o_orderkey % 61 AS s, o_orderkey % 33 AS a, o_orderkey % 37 AS b FROM orders)
SELECT k, CASE WHEN k % 10 = 0 THEN 0 WHEN s < 60 OR s = 60 THEN m * 60 + s END AS seconds, CASE WHEN k % 9 = 0 THEN 0 ELSE a END AS made, CASE WHEN k % 9 = 0 THEN 0 ELSE b END AS tried, least(greatest(2 + k % 6, 3), 6) AS own, CASE WHEN k % 6 = 0 THEN 5 ELSE least(greatest(1 + k % 8, 3), 6) END AS other,
  CASE k % 5 WHEN 0 THEN 100 WHEN 1 THEN 105 + k % 300 WHEN 2 THEN -(105 + k % 300) WHEN 3 THEN 150 END AS american, CASE k % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 5.5 WHEN 2 THEN 6.0 WHEN 3 THEN NULL END AS line, CASE WHEN k % 3 > 0 THEN k % 12 - 0.5 END AS milestone, 'draftkings' || CAST(k % 4 AS VARCHAR) AS venue FROM x"""
)
def parsed_strings(spark, d):
    """Clocks, fractions, strengths, prices, lines, milestones and venue names as feeds write them."""
    k = F.col("k")
    mod = lambda n: F.pmod(k, F.lit(n))
    s = lambda c: c.cast("string")
    x = driver_table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumns({
        "clock": F.when(mod(10) == 0, "--").otherwise(F.concat(s(mod(75)), F.lit(":"), F.lpad(s(mod(61)), 2, "0"))),
        "shots": F.when(mod(9) == 0, "n/a").otherwise(F.concat_ws("/", s(mod(33)), s(mod(37)))),
        "men": F.when(mod(6) == 0, F.concat(s(2 + mod(6)), F.lit("v5"))).otherwise(F.concat(s(2 + mod(6)), F.lit("v"), s(1 + mod(8)))),
        "odds": F.when(mod(5) == 0, " even").when(mod(5) == 1, F.concat(F.lit("+"), s(105 + mod(300)))).when(mod(5) == 2, s(-(105 + mod(300)))).when(mod(5) == 3, "2.5").otherwise("off"),
        "number": F.when(mod(4) == 0, "PK").when(mod(4) == 1, "o5.5").when(mod(4) == 2, "6").otherwise("-"),
        "more": F.when(mod(3) > 0, F.concat(s(mod(12)), F.lit("+"))).otherwise("x"),
        "book": F.concat(F.lit("Draft Kings "), s(mod(4))),
    })
    c = F.col
    made, men = text.fraction(c("shots")), text.strength(c("men"))
    return x.select("k", text.clock_seconds(c("clock")).alias("seconds"), made["made"].alias("made"), made["tried"].alias("tried"), men["own"].alias("own"), men["other"].alias("other"), text.american(c("odds")).alias("american"), text.line(c("number")).alias("line"), text.milestone(c("more")).alias("milestone"), text.venue_key(c("book")).alias("venue"))


@query(
    f"""WITH {BETS}, v AS (SELECT k, list_filter([CASE WHEN c % 10 = 0 THEN 'unknown bettor' END, CASE WHEN k % 6 = 0 THEN 'no platform' END, CASE WHEN k % 8 = 0 OR k % 9 = 0 THEN 'stake' END, CASE WHEN k % 5 = 0 THEN 'no line' END, CASE WHEN abs(k % 400 - 200) < 100 THEN 'odds' END], lambda x: x IS NOT NULL) AS p FROM bets)
SELECT k, array_to_string(p, '; ') AS problems FROM v"""
)
def validated_slips(spark, d):
    """What is wrong with each slip."""
    k = F.col("k")
    mod = lambda n: F.pmod(k, F.lit(n))
    b = _bets(spark, d).withColumns({"platform": F.when(mod(6) == 0, " ").otherwise(F.col("venue")), "stake": F.when(mod(8) == 0, None).when(mod(9) == 0, 0.0).otherwise(F.col("stake")), "line": F.when(mod(5) != 0, 6.5), "odds": mod(400) - 200})
    rules = [(F.pmod("c", F.lit(10)) == 0, "unknown bettor"), (F.trim("platform") == "", "no platform"), (F.coalesce(F.col("stake") <= 0, F.lit(True)), "stake"), (F.col("line").isNull(), "no line"), (F.abs("odds") < 100, "odds")]
    return b.select("k", F.array_join(ledger.problems(rules), "; ").alias("problems"))


@query(
    f"""WITH RECURSIVE {BETS}, w AS (SELECT day, k, p - 0.4 AS edge, least(greatest((({DECIMAL.format("price")} - 1) * p - (1 - p)) / ({DECIMAL.format("price")} - 1), 0) * 0.25, 0.02) AS wish FROM bets),
n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY edge DESC, k) AS i FROM w),
f(day, i, k, spent, stake) AS (SELECT day, i, k, CASE WHEN wish <= 0.1 + 1e-9 THEN wish ELSE 0 END, CASE WHEN wish <= 0.1 + 1e-9 THEN wish ELSE 0 END FROM n WHERE i = 1
  UNION ALL SELECT n.day, n.i, n.k, f.spent + CASE WHEN f.spent + n.wish <= 0.1 + 1e-9 THEN n.wish ELSE 0 END, CASE WHEN f.spent + n.wish <= 0.1 + 1e-9 THEN n.wish ELSE 0 END FROM f JOIN n ON n.day = f.day AND n.i = f.i + 1)
SELECT k, round(stake, 9) AS stake FROM f"""
)
def day_stakes(spark, d):
    """Stakes of each day's bets under a cap for the bet and one for the day."""
    b = _bets(spark, d).withColumns({"edge": F.col("p") - 0.4, "kelly": prices.kelly(F.col("p"), prices.decimal_odds(F.col("price")))})
    return ledger.day_stakes(b, ["day"], "edge", "kelly", ["k"]).select("k", F.round("stake", 9).alias("stake"))


@query(f"""WITH {BETS} SELECT c, count(*) FILTER (WHERE k % 3 = 0) AS bets, coalesce(sum(stake) FILTER (WHERE k % 3 = 0), 0) AS staked, bool_or(k % 3 = 0) AS frozen FROM bets GROUP BY c""")
def issued_exposure(spark, d):
    return ledger.exposure(_bets(spark, d), ["c"], "stake", F.pmod("k", F.lit(3)) == 0)


@query(
    """WITH x AS (SELECT o_custkey AS c, CAST(o_totalprice AS DOUBLE) / 1000 AS y, CAST(o_orderkey % 97 AS DOUBLE) AS x FROM orders), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, var_pop(x) AS vx FROM x),
s AS (SELECT c, sum(y - a - b * x) AS s0, sum((y - a - b * x) * x) AS s1 FROM x, m GROUP BY c), t AS (SELECT count(*) AS g, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM s),
i AS (SELECT (vx + mx * mx) / (n * vx) AS i00, -mx / (n * vx) AS i01, 1 / (n * vx) AS i11 FROM m)
SELECT round(a, 5) AS intercept, round(b, 6) AS slope, round(sqrt(g / (g - 1.0) * (i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11)), 5) AS se_intercept, round(sqrt(g / (g - 1.0) * (i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11)), 6) AS se_slope FROM m, t, i"""
)
def clustered_regression(spark, d):
    x = driver_table(spark, d, "orders").select(F.col("o_custkey").alias("c"), (F.col("o_totalprice").cast("double") / 1000).alias("y"), F.pmod("o_orderkey", F.lit(97)).cast("double").alias("x"))
    out = stats.clustered_regression(x, "y", "x", ["c"])
    return out.select(F.round("intercept", 5).alias("intercept"), r6("slope", "slope"), F.round("se_intercept", 5).alias("se_intercept"), r6("se_slope", "se_slope"))


TEAM_SQL = """
base AS (SELECT custkey AS team, season, day, orderkey AS game_id, qty AS gf, lines AS ga, CASE WHEN orderkey % 9 > 0 THEN rev / 1e4 END AS xgf, CASE WHEN orderkey % 7 > 0 THEN price / 1e4 END AS xga, qty + 5 AS ff, lines + 7 AS fa, returned AS blocks_own, lines AS blocks_opp,
  CASE WHEN orderkey % 11 > 0 THEN 3600.0 END AS toi, qty + lines AS sog_for, lines + 20 AS sog_against, returned AS pp_goals, lines AS pp_opps, returned AS ppga, lines + 1 AS opp_pp_opps, rev / 1e5 AS pp_xgf, price / 1e5 AS pk_xga, returned * 60.0 / 5 AS pp_toi, lines * 30.0 / 4 AS sh_toi, qty AS fow, qty * 2 + 1 AS fo_total, 2.0 * lines AS pim FROM games),
masked AS (SELECT * REPLACE (CASE WHEN xga IS NOT NULL THEN xgf END AS xgf, CASE WHEN xgf IS NOT NULL THEN xga END AS xga), ff + blocks_opp AS cf, fa + blocks_own AS ca FROM base)"""
_R = {"gf_per60": "3600 * {gf} / {toi}", "ga_per60": "3600 * {ga} / {toi}", "xgf_pct": "{xgf} / ({xgf} + {xga})", "cf_pct": "{cf} / ({cf} + {ca})", "ff_pct": "{ff} / ({ff} + {fa})", "sh_pct": "{gf} / {sog_for}", "sv_pct": "1 - {ga} / {sog_against}", "pdo": "{gf} / {sog_for} + 1 - {ga} / {sog_against}", "pp_pct": "{pp_goals} / {pp_opps}",
      "pk_pct": "1 - {ppga} / {opp_pp_opps}", "pp_xgf_per60": "CASE WHEN {pp_toi} > 0 OR {pp_xgf} > 0 THEN least(3600 * {pp_xgf} / {pp_toi}, 99) END", "pk_xga_per60": "CASE WHEN {sh_toi} > 0 OR {pk_xga} > 0 THEN least(3600 * {pk_xga} / {sh_toi}, 99) END", "fow_pct": "{fow} / {fo_total}", "pim_per60": "3600 * {pim} / {toi}"}


def _team_sql() -> str:
    names = sorted({n for r in _R.values() for n in re.findall(r"{(\w+)}", r)})
    sums = ", ".join(f"1.0 * sum({n}) OVER w{k} AS {n}_{k}" for k in (5, 20) for n in names)
    out = ", ".join(f"round(CASE WHEN isfinite({e}) THEN {e} END, 5) AS {name}_{k}" for k in (5, 20) for name, r in _R.items() for e in ["(" + r.format(**{n: f"CAST({n}_{k} AS DOUBLE)" for n in names}) + ")"])
    frame = ", ".join(f"w{k} AS (PARTITION BY team, season ORDER BY day, game_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (5, 20))
    return f"WITH {GAMES}, {TEAM_SQL}, r AS (SELECT game_id, {sums} FROM masked WINDOW {frame}) SELECT game_id, {out} FROM r"


@query(_team_sql())
def team_rates(spark, d):
    """All shares and rates of a side over its games before, in two windows."""
    c, k = F.col, F.col("orderkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    base = games(spark, d).select(
        c("custkey").alias("team"), "season", c("day").alias("date"), k.alias("game_id"), c("qty").cast("double").alias("gf"), c("lines").alias("ga"), F.when(mod(9) > 0, c("rev") / 1e4).alias("xgf"), F.when(mod(7) > 0, c("price").cast("double") / 1e4).alias("xga"),
        (c("qty") + 5).alias("ff"), (c("lines") + 7).alias("fa"), c("returned").alias("blocks_own"), c("lines").alias("blocks_opp"), F.when(mod(11) > 0, 3600.0).otherwise(0.0).alias("toi"), (c("qty") + c("lines")).alias("sog_for"), (c("lines") + 20).alias("sog_against"),
        c("returned").alias("pp_goals"), c("lines").alias("pp_opps"), c("returned").alias("ppga"), (c("lines") + 1).alias("opp_pp_opps"), (c("rev") / 1e5).alias("pp_xgf"), (c("price").cast("double") / 1e5).alias("pk_xga"), (c("returned") * 60.0).alias("pp_toi_raw"), (c("lines") * 30.0).alias("sh_toi_raw"),
        c("qty").alias("fow"), (c("qty") * 2 + 1).alias("fo_total"), (2.0 * c("lines")).alias("pim"),
    )
    out = features.team_rates(features.team_base(base), [5, 20])
    return out.select("game_id", *[F.round(f"{n}_{w}", 5).alias(f"{n}_{w}") for w in (5, 20) for n in features.TEAM_RATES])


@query(
    f"""WITH {GAMES}, a AS (SELECT season, day, orderkey, CAST((qty % 5 - 2) / 8.0 AS DOUBLE) AS adj FROM games)
SELECT orderkey, round(coalesce(sum(adj) OVER w, 0) / (count(adj) OVER w + 25), 5) AS shift, round(3.0 * exp(-coalesce(sum(adj) OVER w, 0) / (count(adj) OVER w + 25)), 6) AS rate FROM a WINDOW w AS (PARTITION BY season ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"""
)
def drift_corrected(spark, d):
    """A rate corrected by what the season so far has shown."""
    from foretime.plans import models

    g = games(spark, d).select("season", F.col("day").alias("date"), "orderkey", ((F.pmod("qty", F.lit(5)) - 2) / 8).cast("double").alias("adj"))
    g = models.with_drift(g, "adj")
    return g.select("orderkey", F.round("shift", 5).alias("shift"), r6(3.0 * F.exp(-F.col("shift")), "rate"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 5 AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 90 * 60 END AS t, 1 + o_orderkey % 82 AS n FROM orders)
SELECT k, CASE WHEN t > 0 THEN round(3600.0 * a / t, 6) END AS per60, CASE WHEN n <= 20 THEN 'EARLY' WHEN n <= 62 THEN 'MID' ELSE 'LATE' END AS stage, least(greatest(n, 10), 60) AS clipped, CASE WHEN t IS NOT NULL THEN a END AS masked FROM x"""
)
def guarded_rates(spark, d):
    k = F.col("o_orderkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    x = driver_table(spark, d, "orders").select(k.alias("k"), mod(5).alias("a"), F.when(mod(4) > 0, mod(90) * 60).alias("t"), (1 + mod(82)).alias("n"))
    both = guards.both_or_neither(x.withColumn("b", F.col("a")).withColumn("u", F.col("t")), [("b", "u")])
    return both.select("k", r6(guards.per60(F.col("a"), F.col("t")), "per60"), guards.stage_of(F.col("n")).alias("stage"), guards.clip(F.col("n"), 10, 60).alias("clipped"), F.col("b").alias("masked"))


@query(
    """WITH s AS (SELECT l_orderkey AS game, l_suppkey AS player, l_linenumber AS n, l_quantity AS secs FROM lineitem), src AS (SELECT o_orderkey AS game, o_orderkey % 3 = 0 AS shots, o_orderkey % 4 = 0 AS box, o_orderdate FROM orders),
g AS (SELECT game FROM src WHERE shots UNION SELECT game FROM src WHERE box), per AS (SELECT game, count(*) AS shifts, count(DISTINCT player) AS players, sum(secs) AS secs FROM s GROUP BY game),
bad AS (SELECT game FROM s GROUP BY game, player HAVING count(*) <> count(DISTINCT n) OR sum(secs) > 60)
SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS games, count(*) FILTER (WHERE per.game IS NOT NULL) AS stored, count(*) FILTER (WHERE per.game IS NULL) AS missing, count(*) FILTER (WHERE players < 3) AS thin, count(*) FILTER (WHERE bad.game IS NOT NULL) AS flagged, median(shifts) AS median_shifts, CAST(sum(shifts) AS BIGINT) AS shifts
FROM g JOIN src USING (game) LEFT JOIN per USING (game) LEFT JOIN (SELECT DISTINCT game FROM bad) bad USING (game) GROUP BY 1"""
)
def coverage_report(spark, d):
    """By season: games that should have rows, those that have, and those whose rows look wrong."""
    s = driver_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("secs"))
    o, k = driver_table(spark, d, "orders"), F.col("o_orderkey")
    src = o.select(k.alias("game"), (F.pmod(k, F.lit(3)) == 0).alias("shots"), (F.pmod(k, F.lit(4)) == 0).alias("box"), F.year("o_orderdate").alias("season"))
    expected = src.filter("shots").select("game").union(src.filter("box").select("game")).distinct().join(src.select("game", "season"), "game")
    per = s.groupBy("game").agg(F.count(F.lit(1)).alias("shifts"), F.count_distinct("player").alias("players"))
    bad = s.groupBy("game", "player").agg(F.count(F.lit(1)).alias("a"), F.count_distinct("n").alias("b"), F.sum("secs").alias("t")).filter("a <> b OR t > 60").select("game").distinct().withColumn("flag", F.lit(True))
    out = expected.join(per, "game", "left").join(bad, "game", "left")
    return out.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"), F.count("shifts").alias("stored"), F.count_if(F.col("shifts").isNull()).alias("missing"), F.count_if(F.col("players") < 3).alias("thin"), F.count("flag").alias("flagged"), F.median("shifts").alias("median_shifts"), F.sum("shifts").alias("shifts")
    )


@query(
    """WITH e AS (SELECT event_type, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events), w AS (SELECT event_type, value, (s // 3600 - k) * 3600 AS a FROM e, (SELECT unnest(range(3)) AS k))
SELECT CAST(a AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2"""
)
def sliding_windows(spark, d):
    """Three-hour windows that start every hour."""
    e = driver_table(spark, d, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    out = changes.windowed(e, "ts", "10 minutes", "3 hours", "1 hour", ["event_type"], "value")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) AS u FROM events), g AS (SELECT *, CASE WHEN u - lag(u) OVER w > 7200000000 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY u)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(min(u) // 1000000 AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    """Sessions of a user that end after two quiet hours."""
    e = driver_table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return changes.sessions(e, "ts", "10 minutes", "2 hours", ["user_id"]).select("user_id", F.unix_seconds("start").alias("start"), "n")


@query(
    """WITH s AS (SELECT user_id, quantile_disc(epoch_us(ts), 0.5) AS start FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT event_id FROM events JOIN s USING (user_id) WHERE epoch_us(ts) < start"""
)
def rows_before_start(spark, d):
    """Rows that come before their item's start."""
    e = driver_table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    starts = e.filter(F.pmod("event_id", F.lit(3)) == 0).groupBy("user_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY u)").cast("long").alias("start"))
    return changes.before_start(e, "u", starts, "user_id", "start").select("event_id")


@query(f"""WITH {GAMES} SELECT orderkey, coalesce(sum(qty) OVER w, 0) AS qty_before FROM games WINDOW w AS (PARTITION BY custkey ORDER BY day, orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def totals_before(spark, d):
    from foretime.operators import pit

    return pit.cumulative_before(games(spark, d), ["custkey"], ["day", "orderkey"], ["qty"]).select("orderkey", "qty_before")
