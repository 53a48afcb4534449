"""Queries of the feed readers: bodies are made of the driver's rows as JSON and HTML, and read again; the SQL goes to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretime.plans.queries import query
from foretime.sources import feeds
from foretime.sources.tables import driver_table


def _mod(c: str | Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))


def _s(c: Column) -> Column:
    return c.cast("string")


LI = "li AS (SELECT l_orderkey AS game_id, l_suppkey AS s, l_partkey AS p, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem QUALIFY k = 1)"


def _games(spark: SparkSession, d: str) -> DataFrame:
    """game_id and men: an array of (s, n, p), one for each supplier of an order: a player of a game. Lines meet by game once, and their columns alone travel."""
    line = F.struct(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "l_quantity", "l_extendedprice")
    games = driver_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(F.sort_array(F.collect_list(line)).alias("men"))
    # of a supplier's lines the first one in order stays
    return games.select("game_id", F.filter("men", lambda x, i: (i == 0) | ~x["s"].eqNullSafe(F.get("men", i - 1)["s"])).alias("men"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    two = lambda a, b: F.concat_ws("/", _s(a), _s(b))

    def player(x: Column) -> Column:
        s, p, n = x["s"], x["p"], x["n"]
        toi = F.concat(_s(_mod(p, 40)), F.lit(":"), F.lpad(_s(_mod(p, 60)), 2, "0"))
        fields = {
            "playerId": s, "position": F.when(_mod(s, 4) > 0, "C"), "toi": F.when(_mod(p, 11) > 0, toi), "goals": F.when(_mod(p, 3) > 0, _mod(p, 3)), "assists": _mod(p, 4), "points": _mod(p, 5), "sog": F.when(_mod(p, 5) > 0, _mod(p, 9)), "shots": F.when(_mod(p, 7) > 0, _mod(p, 8)),
            "hits": _mod(p, 6), "blockedShots": _mod(p, 3), "blocks": F.when(_mod(p, 13) > 0, _mod(p, 12)), "pim": 2 * _mod(n, 3), "plusMinus": _mod(p, 5) - 2, "starter": F.when(_mod(p, 4) > 0, _mod(p, 2) == 0), "decision": F.element_at(F.array(*map(F.lit, ("W", "L", "O", "x"))), (_mod(p, 4) + 1).cast("int")),
            "shotsAgainst": _mod(p, 31), "saves": _mod(p, 29), "goalsAgainst": _mod(p, 6), "evenStrengthShotsAgainst": F.when(_mod(p, 9) > 0, two(_mod(p, 20), _mod(p, 20) + 2)), "powerPlayShotsAgainst": two(_mod(n, 4), _mod(n, 4) + 1),
        }
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    role = lambda home, k: F.transform(F.filter("men", lambda x: (_mod(x["s"], 2) == home) & (_mod(x["s"], 3) == k)), player)
    side = lambda home: F.struct(role(home, 1).alias("forwards"), role(home, 2).alias("defense"), role(home, 0).alias("goalies"))
    body = F.struct(F.struct(F.lit("HHH").alias("abbrev")).alias("homeTeam"), F.struct(F.lit("AAA").alias("abbrev")).alias("awayTeam"), F.struct(side(0).alias("homeTeam"), side(1).alias("awayTeam")).alias("playerByGameStats"))
    return _games(spark, d).select("game_id", F.to_json(body).alias("body"))


@query(f"""WITH {LI} SELECT game_id, CASE WHEN s % 2 = 0 THEN 'HHH' ELSE 'AAA' END AS team, s AS player_id, CASE WHEN s % 4 > 0 THEN 'C' ELSE '' END AS position, CAST(CASE WHEN p % 11 > 0 THEN p % 40 * 60 + p % 60 ELSE 0 END AS INT) AS toi_seconds, CAST(p % 3 AS INT) AS goals, CAST(p % 4 AS INT) AS assists, CAST(p % 5 AS INT) AS points,
  CAST(CASE WHEN p % 5 > 0 THEN p % 9 WHEN p % 7 > 0 THEN p % 8 ELSE 0 END AS INT) AS shots, CAST(p % 6 AS INT) AS hits, CAST(CASE WHEN p % 3 > 0 THEN p % 3 WHEN p % 13 > 0 THEN p % 12 ELSE 0 END AS INT) AS blocks, CAST(n % 3 * 2 AS INT) AS pim, CAST(p % 5 - 2 AS INT) AS plus_minus FROM li WHERE s % 3 > 0 AND s > 0""")
def skater_lines(spark, d):
    return feeds.skater_lines(_boxes(spark, d))


@query(f"""WITH {LI}, g AS (SELECT *, CASE WHEN p % 11 > 0 THEN p % 40 * 60 + p % 60 ELSE 0 END AS toi FROM li WHERE s % 3 = 0 AND s > 0)
SELECT game_id, CASE WHEN s % 2 = 0 THEN 'HHH' ELSE 'AAA' END AS team, s AS player_id, CASE p % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'L' WHEN 2 THEN 'OTL' END AS decision, CASE WHEN p % 4 > 0 THEN p % 2 = 0 ELSE toi > 1800 END AS is_starter, CAST(p % 31 AS INT) AS shots_against, CAST(p % 29 AS INT) AS saves, CAST(p % 6 AS INT) AS goals_against,
  CASE WHEN p % 31 > 0 THEN round(p % 29 / (p % 31)::DOUBLE, 6) END AS sv_pct, CAST(toi AS INT) AS toi_seconds, CAST(CASE WHEN p % 9 > 0 THEN p % 20 + 2 ELSE 0 END AS INT) AS even_shots, CAST(CASE WHEN p % 9 > 0 THEN p % 20 ELSE 0 END AS INT) AS even_saves, CAST(n % 4 + 1 AS INT) AS pp_shots, CAST(n % 4 AS INT) AS pp_saves, 0 AS sh_shots, 0 AS sh_saves FROM g""")
def goalie_lines(spark, d):
    return feeds.goalie_lines(_boxes(spark, d)).withColumn("sv_pct", F.round("sv_pct", 6))


@query(f"""WITH {LI}, c AS (SELECT game_id, count(DISTINCT s) FILTER (WHERE s % 4 = 0) AS h, count(DISTINCT s) FILTER (WHERE s % 4 = 1) AS a, count(DISTINCT s % 3) FILTER (WHERE s % 4 = 2) AS r, count(DISTINCT s % 5) FILTER (WHERE s % 4 = 3) AS l FROM li GROUP BY game_id)
SELECT game_id, CASE WHEN game_id % 8 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN game_id % 8 > 0 THEN 'Coach ' || game_id % 9 END AS home_coach, CAST(NULL AS VARCHAR) AS away_coach, CASE WHEN game_id % 8 > 0 THEN h ELSE 0 END AS n_scratches_home, CASE WHEN game_id % 8 > 0 THEN a ELSE 0 END AS n_scratches_away, CASE WHEN game_id % 8 > 0 THEN r ELSE 0 END AS n_referees, CASE WHEN game_id % 8 > 0 THEN l ELSE 0 END AS n_linesmen FROM c""")
def game_info(spark, d):
    name = lambda c: F.struct(c.alias("default"))
    man = lambda x: F.struct(x["s"].alias("id"), name(F.concat(F.lit("F"), _s(x["s"]))).alias("firstName"), name(F.lit("Last")).alias("lastName"))
    of = lambda k, f: F.transform(F.filter("men", lambda x: _mod(x["s"], 4) == k), f)
    # everyone is listed twice
    listed = lambda k: F.flatten(F.array(*[of(k, man)] * 2))
    official = lambda k, n: of(k, lambda x: F.struct(name(F.concat(F.lit(" Off "), _s(_mod(x["s"], n)))).alias("fullName"), _mod(x["s"], 90).alias("sweaterNumber")))
    coach = name(F.concat(F.lit("Coach "), _s(_mod("game_id", 9))))
    info = F.struct(F.struct(coach.alias("headCoach"), listed(0).alias("scratches")).alias("homeTeam"), F.struct(name(F.lit(" ")).alias("headCoach"), listed(1).alias("scratches")).alias("awayTeam"), official(2, 3).alias("referees"), official(3, 5).alias("linesmen"))
    rows = _games(spark, d).select("game_id", F.when(_mod("game_id", 8) > 0, F.to_json(F.struct(info.alias("gameInfo")))).otherwise("{}").alias("body"), F.lit("HHH").alias("home"), F.lit("AAA").alias("away"))
    return feeds.game_info(rows)


#: Fixed value: order keys of which a body holds games. With more games there are more bodies, not longer ones.
_BODY_KEYS = 20000


def _block() -> Column:
    return F.floor(F.col("o_orderkey") / _BODY_KEYS).alias("block")


_IMPLIED = "CASE WHEN {0} < 0 THEN -{0} / (100.0 - {0}) ELSE 100.0 / (100 + {0}) END"
_BOTH = f"({_IMPLIED.format('h')} + {_IMPLIED.format('a')})"
PARTNER = f"""raw AS (SELECT o_orderkey AS game_id, o_orderkey % 3 AS prov, o_custkey % 50 AS x, o_orderkey % 70 AS y FROM orders WHERE o_orderkey > 0),
ml AS (SELECT game_id, 'ml' AS market, -(110 + x) AS h, 100 + y AS a, NULL AS line FROM raw WHERE prov < 2),
pl AS (SELECT game_id, 'pl', 150 + x, -(170 + y), CASE WHEN x % 2 = 0 THEN -1.5 ELSE 1.5 END FROM raw WHERE x % 3 > 0),
total AS (SELECT game_id, 'total', -(105 + x % 20), -(100 + y % 30), 5.5 FROM raw WHERE y % 2 = 0)"""


@query(f"""WITH {PARTNER}, every AS (SELECT * FROM ml UNION ALL SELECT * FROM pl UNION ALL SELECT * FROM total)
SELECT game_id, market, h AS first_price, a AS second_price, CAST(line AS DOUBLE) AS line FROM every WHERE {_BOTH} BETWEEN 0.97 AND 1.25""")
def partner_quotes(spark, d):
    """Three markets of a partner's feed; prices that don't add up, half markets and totals at two lines go."""
    k, x, y = F.col("o_orderkey"), _mod("o_custkey", 50), _mod("o_orderkey", 70)
    odd = lambda what, value, q=None: F.struct(F.lit(what).alias("description"), value.alias("value"), (F.lit(q) if q is None or isinstance(q, str) else q).cast("string").alias("qualifier"))
    plus = lambda c: F.concat(F.lit("+"), _s(c))
    spread = F.when(x % 2 == 0, -1.5).otherwise(1.5)
    home = F.array(odd("MONEY_LINE_2_WAY", _s(-(110 + x))), odd("PUCK_LINE", plus(150 + x), spread), odd("OVER_UNDER", _s(-(105 + x % 20)), "O5.5"), odd("MONEY_LINE_2_WAY", F.lit("-999")))
    away = F.array(
        odd("MONEY_LINE_2_WAY", F.when(_mod("o_orderkey", 3) < 2, plus(100 + y))), odd("PUCK_LINE", _s(-(170 + y)), F.when(x % 3 > 0, -spread).otherwise(F.lit(9.5))), odd("OVER_UNDER", _s(-(100 + y % 30)), F.when(y % 2 == 0, "u5.5").otherwise("u6.5"))
    )
    game = F.struct(k.alias("gameId"), F.struct(home.alias("odds")).alias("homeTeam"), F.struct(away.alias("odds")).alias("awayTeam"))
    body = F.struct(F.struct(F.lit("Some Book!").alias("name")).alias("bettingPartner"), F.collect_list(game).alias("games"))
    bodies = driver_table(spark, d, "orders").groupBy(_mod("o_custkey", 20).alias("c"), _block()).agg(F.to_json(body).alias("body")).withColumn("source", F.lit("partner"))
    out = feeds.partner_quotes(bodies).filter("book = 'somebook'")
    over = F.col("market") == "total"
    return out.select("game_id", "market", F.when(over, F.col("over_price")).otherwise(F.col("home_price")).alias("first_price"), F.when(over, F.col("under_price")).otherwise(F.col("away_price")).alias("second_price"), "line")


@query(f"""WITH raw AS (SELECT o_orderkey AS game_id, unnest([1, 2, 7]) AS prov, o_custkey % 50 AS x, o_orderkey % 70 AS y FROM orders WHERE o_orderkey > 0),
priced AS (SELECT game_id, CASE prov WHEN 1 THEN 'bookone' WHEN 2 THEN 'booktwo' ELSE 'provider7' END AS book, CASE WHEN prov = 2 THEN -CAST(floor(100 / (0.5 + x / 1000.0) + 0.5) AS BIGINT) ELSE -(110 + x) END AS h, CASE WHEN prov = 2 AND y % 2 = 0 THEN NULL ELSE 100 + y END AS a FROM raw)
SELECT game_id, book, CASE WHEN game_id % 4 = 0 THEN 'in_play' WHEN game_id % 5 = 0 THEN 'unknown_game' WHEN game_id % 7 = 0 THEN 'no_start' ELSE 'kept' END AS fate, h AS home_price, a AS away_price FROM priced WHERE a IS NOT NULL AND {_BOTH} BETWEEN 0.97 AND 1.25 AND NOT (game_id % 4 = 0 AND game_id % 5 = 0)""")
def schedule_quotes(spark, d):
    """Prices of three venues in a schedule, one of them decimal, and what becomes of them."""
    k, x, y = F.col("o_orderkey"), _mod("o_custkey", 50), _mod("o_orderkey", 70)
    odd = lambda p, value: F.struct(F.lit(p).alias("providerId"), value.alias("value"))
    decimal = _s(F.round(F.lit(1.5) + x / 1000, 3))
    home = F.array(odd(1, F.lit("2.5")), odd(1, _s(-(110 + x))), odd(2, decimal), odd(7, _s(-(110 + x))))
    away = F.array(odd(1, _s(100 + y)), odd(2, F.when(y % 2 > 0, _s(100 + y))), odd(7, _s(100 + y)))
    game = F.struct(k.alias("id"), F.when(_mod("o_orderkey", 4) == 0, "LIVE").otherwise("FUT").alias("gameState"), F.struct(home.alias("odds")).alias("homeTeam"), F.struct(away.alias("odds")).alias("awayTeam"))
    partner = F.array(F.struct(F.lit(1).alias("partnerId"), F.lit("Book One").alias("name")), F.struct(F.lit(2).alias("partnerId"), F.lit("Book-Two").alias("name")))
    body = F.struct(partner.alias("oddsPartners"), F.array(F.struct(F.collect_list(game).alias("games"))).alias("gameWeek"))
    orders = driver_table(spark, d, "orders")
    bodies = orders.groupBy(_mod("o_custkey", 20).alias("c"), _block()).agg(F.to_json(body).alias("body"))
    games = orders.filter("o_orderkey % 5 > 0").select(k.alias("game_id"), F.when(_mod("o_orderkey", 7) > 0, F.lit("2030-01-01").cast("timestamp")).alias("start"))
    out = feeds.judged_quotes(feeds.schedule_quotes(bodies), games, F.lit("2024-01-01").cast("timestamp"))
    return out.filter("NOT (game_id % 4 = 0 AND game_id % 5 = 0)").select("game_id", "book", "fate", F.col("home_price").cast("long").alias("home_price"), F.col("away_price").cast("long").alias("away_price"))


_DK = "o_orderkey % 2 = 0"


@query(f"""WITH b AS (SELECT o_orderkey AS game_id, {_DK} AS dk, o_custkey % 40 AS x, o_orderkey % 30 AS y, o_orderkey % 5 AS z FROM orders),
r AS (SELECT game_id, CASE WHEN dk THEN 'DraftKings' ELSE 'Unibet' END AS provider, -(120 + x) AS home_ml, 100 + y AS away_ml, -1.5 AS spread, 5.5 + z % 2 AS over_under, CASE WHEN dk THEN -(115 + x) ELSE -(125 + x) END AS home_ml_open, CASE WHEN dk THEN 105 + y ELSE 95 + y END AS away_ml_open,
  6.5 AS total_open, CASE WHEN z > 0 THEN -(105 + x) WHEN dk AND z % 2 = 0 THEN -(101 + x) END AS ov, CASE WHEN z > 0 THEN -(104 + y) WHEN dk THEN NULL END AS un, CASE WHEN dk THEN -(103 + x) ELSE 110 + x END AS ovo, CASE WHEN dk THEN -(102 + y) ELSE 110 + y END AS uno FROM b)
SELECT game_id, provider, CAST(home_ml AS INT) AS home_ml, CAST(away_ml AS INT) AS away_ml, CAST(home_ml_open AS INT) AS home_ml_open, CAST(CASE WHEN abs(away_ml_open) >= 100 THEN away_ml_open END AS INT) AS away_ml_open, CAST(total_open AS DOUBLE) AS total_open,
  CAST(CASE WHEN ov IS NULL OR un IS NULL OR {_IMPLIED.format('ov')} + {_IMPLIED.format('un')} BETWEEN 1.0 - 1e-9 AND 1.2 + 1e-9 THEN ov END AS INT) AS over_price, CAST(CASE WHEN ov IS NULL OR un IS NULL OR {_IMPLIED.format('ov')} + {_IMPLIED.format('un')} BETWEEN 1.0 - 1e-9 AND 1.2 + 1e-9 THEN un END AS INT) AS under_price,
  CAST(CASE WHEN {_IMPLIED.format('ovo')} + {_IMPLIED.format('uno')} BETWEEN 1.0 - 1e-9 AND 1.2 + 1e-9 THEN ovo END AS INT) AS over_price_open FROM r""")
def pick_center(spark, d):
    """Blocks of both layouts; every fifth has no prices at its top, and its close counts only at the same line."""
    dk, x, y, z = F.col("o_orderkey") % 2 == 0, _mod("o_custkey", 40), _mod("o_orderkey", 30), _mod("o_orderkey", 5)
    if_dk, if_not = lambda c: F.when(dk, c), lambda c: F.when(~dk, c)
    american = lambda c: F.struct(c.alias("american"))
    priced = lambda odds, line=None: F.struct(_s(odds).alias("odds"), F.lit(line).cast("string").alias("line"))
    team = lambda ml, o: F.struct(ml.alias("moneyLine"), if_not(F.struct(american(_s(o)).alias("moneyLine"))).alias("open"))
    plus = lambda c: F.concat(F.lit("+"), _s(c))
    body = F.struct(
        F.struct(F.when(dk, "DraftKings").otherwise("Unibet").alias("name")).alias("provider"), (5.5 + z % 2).cast("double").alias("overUnder"), F.lit(-1.5).alias("spread"), F.when(z > 0, -(105 + x)).alias("overOdds"), F.when(z > 0, -(104 + y)).alias("underOdds"),
        team(-(120 + x), -(125 + x)).alias("homeTeamOdds"), team(100 + y, plus(95 + y)).alias("awayTeamOdds"), if_dk(F.struct(F.struct(priced(-(115 + x)).alias("open")).alias("home"), F.struct(priced(plus(105 + y)).alias("open")).alias("away"))).alias("moneyline"),
        if_dk(F.struct(F.struct(priced(-(103 + x), "o6.5").alias("open"), priced(-(101 + x), "o5.5").alias("close")).alias("over"), F.struct(priced(-(102 + y), "u6.5").alias("open"), priced(F.lit(-150), "u7.5").alias("close")).alias("under"))).alias("total"),
        if_not(F.struct(american(plus(110 + x)).alias("over"), american(plus(110 + y)).alias("under"), american(F.lit("6.5")).alias("total"))).alias("open"),
    )
    out = feeds.pick_center(driver_table(spark, d, "orders").select(F.col("o_orderkey").alias("game_id"), F.to_json(body).alias("body")), ["game_id"])
    return out.select("game_id", "provider", "home_ml", "away_ml", "home_ml_open", "away_ml_open", "total_open", "over_price", "under_price", "over_price_open")


@query("""WITH li AS (SELECT o_custkey % 300 AS page, l_suppkey % 20 AS who, l_linenumber % 4 + 1 AS u, l_partkey % 3 AS t, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS q, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
placed AS (SELECT *, 'F' || u AS unit, ['lw', 'c', 'rw'][t + 1] AS slot FROM li UNION ALL SELECT *, 'PP1', 's' || (who % 3) FROM li),
f AS (SELECT page, unit, slot, who, seq, p, q, row_number() OVER (PARTITION BY page, unit, slot ORDER BY seq, unit, who, p, q) AS k FROM placed), first AS (SELECT * FROM f WHERE k = 1),
own AS (SELECT page, who, upper(['l', 'c', 'r'][CASE slot WHEN 'lw' THEN 1 WHEN 'c' THEN 2 ELSE 3 END]) AS pos FROM first WHERE unit <> 'PP1' QUALIFY row_number() OVER (PARTITION BY page, who ORDER BY seq DESC, unit DESC, p DESC, q DESC) = 1)
SELECT first.page, unit, slot, 'Player ' || first.who AS player_name, CASE WHEN unit = 'PP1' THEN pos ELSE upper(['l', 'c', 'r'][CASE slot WHEN 'lw' THEN 1 WHEN 'c' THEN 2 ELSE 3 END]) END AS position FROM first LEFT JOIN own ON own.page = first.page AND own.who = first.who""")
def lineup_pages(spark, d):
    """Pages of line-ups made of orders: the first of a slot stays, and power-play units take the position of even strength."""
    o, li = driver_table(spark, d, "orders"), driver_table(spark, d, "lineitem")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(_mod("o_custkey", 300).alias("page"), _mod("l_suppkey", 20).alias("who"), (_mod("l_linenumber", 4) + 1).alias("u"), _mod("l_partkey", 3).alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    name = F.concat(F.lit(" Player "), _s(F.col("who")), F.lit(" "))
    entry = lambda unit, slot, kind: F.struct(name.alias("name"), unit.alias("groupIdentifier"), slot.alias("positionIdentifier"), F.lit(kind).alias("categoryIdentifier"))
    slot = F.element_at(F.array(*map(F.lit, ("LW", "c", "rw"))), (F.col("t") + 1).cast("int"))
    both = rows.select("page", "at", "who", "p", "q", F.explode(F.array(entry(F.concat(F.lit("f"), _s(F.col("u"))), slot, "ev"), entry(F.lit("pp1"), F.concat(F.lit("S"), _s(_mod("who", 3))), "pp"))).alias("e"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", F.upper("e.groupIdentifier").alias("g"), "who", "p", "q", "e"))), lambda x: x["e"])
    body = F.struct(F.struct(F.struct(F.struct(F.lit("T").alias("teamName"), listed.alias("players")).alias("combinations")).alias("pageProps")).alias("props"))
    pages = both.groupBy("page").agg(F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(body), F.lit("</script>")).alias("html"))
    return feeds.lineups(pages, ["page"]).select("page", "unit", "slot", "player_name", "position")
