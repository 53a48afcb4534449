"""Bodies of feeds (JSON, and HTML with JSON in it) as rows, by declared schemas: fields that may be text or number are read as text.

Every reader takes one body a row and goes through it with array functions, in one scan and without a shuffle, but for what
merges entries of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.functions.prices import implied
from foretime.functions.text import american, clock_seconds, fraction, line, milestone, venue_key
from foretime.sources.tables import embedded_json


def instant(c: Column) -> Column:
    """A time of day and zone with or without seconds; NULL for anything else."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSS]XXX")), c.try_cast("timestamp"))


# --- box scores -----------------------------------------------------------------------------------------------------------------

#: What is read of a skater and of a goalie; the rest of an entry is skipped.
_SKATER = "array<struct<playerId:long,position:string,toi:string,goals:int,assists:int,points:int,sog:int,shots:int,hits:int,blockedShots:int,blocks:int,pim:int,plusMinus:int>>"
_GOALIE = "array<struct<playerId:long,toi:string,starter:boolean,decision:string,shotsAgainst:int,saves:int,goalsAgainst:int,evenStrengthShotsAgainst:string,powerPlayShotsAgainst:string,shorthandedShotsAgainst:string>>"
#: Fixed value: who played longer than so many seconds started, where the box score doesn't say.
STARTER_SECONDS = 1800


def _box_players(bodies: DataFrame, roles: tuple[str, ...], player: str) -> DataFrame:
    side = f"struct<{','.join(f'{role}:{player}' for role in roles)}>"
    b = bodies.select("game_id", F.from_json("body", f"homeTeam struct<abbrev:string>, awayTeam struct<abbrev:string>, playerByGameStats struct<homeTeam:{side},awayTeam:{side}>").alias("b"))
    group = lambda s, role: F.struct(F.col(f"b.{s}.abbrev").alias("team"), F.coalesce(F.col(f"b.playerByGameStats.{s}.{role}"), F.from_json(F.lit("[]"), player)).alias("players"))
    rows = b.select("game_id", F.inline(F.array(*[group(s, role) for s in ("homeTeam", "awayTeam") for role in roles])))
    return rows.select("game_id", "team", F.explode("players").alias("p")).filter("p.playerId <> 0")


def skater_lines(bodies: DataFrame) -> DataFrame:
    """A row for each skater of box scores (game_id, body); counts that are missing are 0."""
    count = lambda *names: F.coalesce(*[F.col(f"p.{n}") for n in names], F.lit(0)).alias(names[0])
    blocks = F.coalesce(F.nullif(F.col("p.blockedShots"), F.lit(0)), F.col("p.blocks"), F.lit(0)).alias("blocks")
    rows = _box_players(bodies, ("forwards", "defense"), _SKATER)
    return rows.select(
        "game_id", "team", F.col("p.playerId").alias("player_id"), F.coalesce("p.position", F.lit("")).alias("position"), clock_seconds(F.coalesce("p.toi", F.lit("0:00"))).alias("toi_seconds"), count("goals"), count("assists"), count("points"),
        F.coalesce("p.sog", "p.shots", F.lit(0)).alias("shots"), count("hits"), blocks, count("pim"), F.coalesce("p.plusMinus", F.lit(0)).alias("plus_minus"),
    )


def goalie_lines(bodies: DataFrame) -> DataFrame:
    """A row for each goalie of box scores, with his saves and shots by strength."""
    count = lambda n: F.coalesce(f"p.{n}", F.lit(0))
    toi, shots, saves = clock_seconds(F.coalesce("p.toi", F.lit("0:00"))), count("shotsAgainst"), count("saves")
    split = {"even": "evenStrengthShotsAgainst", "pp": "powerPlayShotsAgainst", "sh": "shorthandedShotsAgainst"}
    by = {k: fraction(F.coalesce(f"p.{n}", F.lit(""))) for k, n in split.items()}
    decision = F.when(F.col("p.decision") == "O", "OTL").when(F.col("p.decision").isin("W", "L"), F.col("p.decision"))
    return _box_players(bodies, ("goalies",), _GOALIE).select(
        "game_id", "team", F.col("p.playerId").alias("player_id"), decision.alias("decision"), F.coalesce("p.starter", toi > STARTER_SECONDS).alias("is_starter"), shots.alias("shots_against"), saves.alias("saves"), count("goalsAgainst").alias("goals_against"),
        F.when(shots > 0, saves / shots).alias("sv_pct"), toi.alias("toi_seconds"), *[c for k, f in by.items() for c in (f["tried"].alias(f"{k}_shots"), f["made"].alias(f"{k}_saves"))],
    )


# --- what is known of a game --------------------------------------------------------------------------------------------------------

_SCRATCHED = "struct<headCoach:struct<default:string>,scratches:array<struct<id:long,firstName:struct<default:string>,lastName:struct<default:string>>>>"
_OFFICIAL = "array<struct<fullName:struct<default:string>,sweaterNumber:int>>"
_INFO = f"gameInfo struct<homeTeam:{_SCRATCHED},awayTeam:{_SCRATCHED},referees:{_OFFICIAL},linesmen:{_OFFICIAL}>"


def _info(bodies: DataFrame) -> DataFrame:
    return bodies.withColumn("g", F.from_json("body", _INFO)["gameInfo"])


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def scratches(bodies: DataFrame) -> DataFrame:
    """game_id, side, team, player_id, player_name of bodies (game_id, home, away, body): a player who is listed twice counts for the first side."""
    rows = _info(bodies)
    side = lambda s, t, k: F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), F.col(t).alias("team"), F.col(f"g.{s}Team.scratches").alias("players"))
    each = rows.select("game_id", F.inline(F.array(side("home", "home", 0), side("away", "away", 1)))).select("game_id", "k", "side", "team", F.posexplode("players").alias("at", "p")).filter("p.id IS NOT NULL")
    name = _text(F.concat_ws(" ", _text(F.col("p.firstName.default")), _text(F.col("p.lastName.default"))))
    first = F.min_by(F.struct("side", "team", name.alias("player_name")), F.struct("k", "at"))
    return each.groupBy("game_id", F.col("p.id").alias("player_id")).agg(first.alias("r")).select("game_id", "r.side", "r.team", "player_id", "r.player_name")


def officials(bodies: DataFrame) -> DataFrame:
    """game_id, role, official_name, sweater_number: each name once for a role."""
    group = lambda key, role: F.struct(F.lit(role).alias("role"), F.col(f"g.{key}").alias("who"))
    each = _info(bodies).select("game_id", F.inline(F.array(group("referees", "referee"), group("linesmen", "linesman")))).select("game_id", "role", F.posexplode("who").alias("at", "o"))
    each = each.withColumn("official_name", _text(F.col("o.fullName.default"))).filter("official_name IS NOT NULL")
    return each.groupBy("game_id", "role", "official_name").agg(F.min_by("o.sweaterNumber", "at").alias("sweater_number"))


#: What the counts need: ids of the scratched and names of officials.
_COUNTED_SIDE = "struct<headCoach:struct<default:string>,scratches:array<struct<id:long>>>"
_COUNTED_OFFICIAL = "array<struct<fullName:struct<default:string>>>"
_COUNTED = f"gameInfo struct<homeTeam:{_COUNTED_SIDE},awayTeam:{_COUNTED_SIDE},referees:{_COUNTED_OFFICIAL},linesmen:{_COUNTED_OFFICIAL}>"


def game_info(bodies: DataFrame) -> DataFrame:
    """game_id, status (ok, or empty without the block), coaches, and how many scratches and officials there are: those that `scratches` and `officials` list, counted in the body, which is read once."""
    g = bodies.select("game_id", F.from_json("body", _COUNTED)["gameInfo"].alias("g"))
    ids = lambda s: F.coalesce(F.array_compact(F.col(f"g.{s}Team.scratches.id")), F.expr("CAST(array() AS array<bigint>)"))
    g = g.select("game_id", F.col("g").isNull().alias("none"), F.col("g.homeTeam.headCoach.default").alias("home_coach"), F.col("g.awayTeam.headCoach.default").alias("away_coach"), ids("home").alias("home"), ids("away").alias("away"), F.col("g.referees.fullName.default").alias("referees"), F.col("g.linesmen.fullName.default").alias("linesmen"))
    names = lambda c: F.array_remove(F.array_distinct(F.array_compact(F.transform(c, lambda x: F.trim(x)))), F.lit(""))
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    return g.select(
        "game_id", F.when(F.col("none"), "empty").otherwise("ok").alias("status"), _text(F.col("home_coach")).alias("home_coach"), _text(F.col("away_coach")).alias("away_coach"), count(F.array_distinct("home")).alias("n_scratches_home"),
        count(F.array_except("away", "home")).alias("n_scratches_away"), count(names("referees")).alias("n_referees"), count(names("linesmen")).alias("n_linesmen"),
    )


# --- prices -----------------------------------------------------------------------------------------------------------------------

#: The range in which the implied chances of a market's sides sum up when its prices are real.
REAL_SUM = {"ml": (0.97, 1.25), "pl": (0.97, 1.25), "total": (0.97, 1.25), "ml3": (0.97, 1.40)}
#: States of games under way or over, and venues left out.
IN_PLAY, EXCLUDED = ("LIVE", "CRIT", "FINAL", "OFF"), ("veikkaus",)
_PRICES = ("home_price", "away_price", "over_price", "under_price", "draw_price", "line")


def feed_price(c: Column) -> Column:
    """A feed's price as American odds: signed or three-digit numbers are it already, a bare number over 1 and under 100 is decimal; halves are rounded away from zero."""
    t = F.trim(c)
    x = t.try_cast("double")
    decimal = F.when(x >= 2, F.floor((x - 1) * 100 + 0.5)).when(x > 1, -F.floor(100 / (x - 1) + 0.5))
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite & (F.abs(x) >= 100), F.signum(x) * F.floor(F.abs(x) + 0.5)).when(finite & ~F.substring(t, 1, 1).isin("+", "-"), decimal).cast("int")


def plausible(quotes: DataFrame) -> DataFrame:
    """Quotes (market and prices) whose sides are all priced and whose implied chances sum up as real prices do."""
    two = lambda a, b: implied(F.col(a)) + implied(F.col(b))
    total = F.when(F.col("market") == "total", two("over_price", "under_price")).when(F.col("market") == "ml3", two("home_price", "away_price") + implied(F.col("draw_price"))).otherwise(two("home_price", "away_price"))
    ok = F.lit(False)
    for market, (low, high) in REAL_SUM.items():
        ok = ok | ((F.col("market") == market) & total.between(low, high))
    return quotes.filter(F.coalesce(ok, F.lit(False)))


_ODDS = "array<struct<description:string,value:string,qualifier:string,providerId:long>>"
_TEAM = f"struct<odds:{_ODDS}>"
_PARTNER = f"bettingPartner struct<name:string,partnerId:long>, lastUpdatedUTC timestamp, games array<struct<gameId:long,startTimeUTC:timestamp,homeTeam:{_TEAM},awayTeam:{_TEAM}>>"


def partner_quotes(bodies: DataFrame) -> DataFrame:
    """game_id, source, book, updated, start, market (ml, pl, total, ml3) and prices of bodies (source, body): markets of which every side has a price, and that look real."""
    b = bodies.select("source", F.from_json("body", _PARTNER).alias("b"))
    book = F.coalesce(F.nullif(venue_key(F.col("b.bettingPartner.name")), F.lit("")), F.concat(F.lit("partner"), F.coalesce(F.col("b.bettingPartner.partnerId").cast("string"), F.lit(""))))
    # a body's list alone goes into the explosion: a body beside it would be copied for each of its games
    b = b.select("source", book.alias("book"), F.col("b.lastUpdatedUTC").alias("updated"), F.col("b.games").alias("games"))
    g = b.select("source", "book", "updated", F.explode("games").alias("g")).filter("g.gameId <> 0")
    none = F.from_json(F.lit("[]"), _ODDS)
    entries = lambda side: F.transform(F.coalesce(F.col(f"g.{side}.odds"), none), lambda o: F.struct(F.coalesce(o["description"], F.lit("")).alias("d"), feed_price(o["value"]).alias("price"), F.trim(F.coalesce(o["qualifier"], F.lit(""))).alias("q")))
    g = g.withColumns({"h": entries("homeTeam"), "a": entries("awayTeam")})
    draw = lambda o: F.lower(o["q"]) == "draw"
    first = lambda who, d, drawn=False: F.try_element_at(F.filter(who, lambda o: (o["d"] == d) & (draw(o) if drawn else ~draw(o))), F.lit(1))
    two, puck, three = "MONEY_LINE_2_WAY", "PUCK_LINE", "MONEY_LINE_3_WAY"
    totals = F.filter(F.concat("h", "a"), lambda o: o["d"] == "OVER_UNDER")
    side = lambda letter: F.try_element_at(F.filter(totals, lambda o: F.upper(F.substring(o["q"], 1, 1)) == letter), F.lit(1))
    number = lambda c: c.try_cast("double")
    of = lambda x: number(F.substring(x["q"], 2, 99))
    home_line, away_line = number(first("h", puck)["q"]), number(first("a", puck)["q"])
    null = F.lit(None)
    priced = lambda market, **p: F.struct(F.lit(market).alias("market"), *[p.get(n, null).cast("double" if n == "line" else "int").alias(n) for n in _PRICES])
    drawn = F.coalesce(first("h", three, True)["price"], first("a", three, True)["price"])
    markets = F.array(
        priced("ml", home_price=first("h", two)["price"], away_price=first("a", two)["price"]),
        priced("pl", home_price=first("h", puck)["price"], away_price=first("a", puck)["price"], line=F.when(away_line.isNull() | (away_line == -home_line), home_line)),
        priced("total", over_price=side("O")["price"], under_price=side("U")["price"], line=F.when(of(side("O")) == of(side("U")), of(side("O")))),
        priced("ml3", home_price=first("h", three)["price"], away_price=first("a", three)["price"], draw_price=drawn),
    )
    out = g.select(F.col("g.gameId").alias("game_id"), "source", "book", "updated", F.col("g.startTimeUTC").alias("start"), F.inline(markets))
    return plausible(out.filter(~F.col("market").isin("pl", "total") | F.col("line").isNotNull()))


_SCHEDULE = f"oddsPartners array<struct<partnerId:long,name:string>>, gameWeek array<struct<games:array<struct<id:long,startTimeUTC:timestamp,gameState:string,homeTeam:{_TEAM},awayTeam:{_TEAM}>>>>"


def schedule_quotes(bodies: DataFrame) -> DataFrame:
    """game_id, book, start, state, home_price, away_price (market ml) of schedules (body) with prices: a row for each game and venue that priced both sides; of several prices of one side the last counts."""
    b = bodies.select(F.from_json("body", _SCHEDULE).alias("b"))
    b = b.select("b.oddsPartners", F.flatten(F.transform("b.gameWeek", lambda d: F.coalesce(d["games"], F.expr("array()")))).alias("games"))
    g = b.select("oddsPartners", F.explode("games").alias("g")).filter("g.id <> 0")
    none = F.from_json(F.lit("[]"), _ODDS)
    known = lambda side: F.filter(F.coalesce(F.col(f"g.{side}.odds"), none), lambda o: o["providerId"].isNotNull())
    g = g.withColumns({"h": known("homeTeam"), "a": known("awayTeam")})
    ids = F.array_distinct(F.transform(F.concat("h", "a"), lambda o: o["providerId"]))
    each = g.select("oddsPartners", "g", "h", "a", F.explode(ids).alias("provider"))
    last = lambda who: F.try_element_at(F.filter(who, lambda o: o["providerId"] == F.col("provider")), F.lit(-1))["value"]
    name = F.nullif(venue_key(F.try_element_at(F.filter("oddsPartners", lambda p: p["partnerId"] == F.col("provider")), F.lit(-1))["name"]), F.lit(""))
    out = each.select(
        F.col("g.id").alias("game_id"), F.coalesce(name, F.concat(F.lit("provider"), F.col("provider").cast("string"))).alias("book"), F.col("g.startTimeUTC").alias("start"), F.col("g.gameState").alias("state"), F.lit("ml").alias("market"), feed_price(last("h")).alias("home_price"), feed_price(last("a")).alias("away_price"),
        *[F.lit(None).cast("int").alias(n) for n in ("over_price", "under_price", "draw_price")],
    )
    return plausible(out.filter("home_price IS NOT NULL AND away_price IS NOT NULL")).drop("over_price", "under_price", "draw_price")


def judged_quotes(quotes: DataFrame, games: DataFrame, now: Column, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """quotes with fate: kept, excluded (venue), unknown_game, in_play (by state or start), no_start. games: game_id, start; a quote's own start comes first. Its state may be missing."""
    g = games.select("game_id", F.col("start").alias("__start"), F.lit(True).alias("__known"))
    rows = quotes.join(g, "game_id", "left")
    start = F.coalesce("start", "__start")
    state = F.col("state").isin(*IN_PLAY) if "state" in quotes.columns else F.lit(False)
    fate = F.when(F.col("book").isin(*excluded), "excluded").when(F.col("__known").isNull(), "unknown_game").when(F.coalesce(state, F.lit(False)) | F.coalesce(start <= now, F.lit(False)), "in_play").when(start.isNull(), "no_start").otherwise("kept")
    return rows.withColumn("fate", fate).drop("__start", "__known")


# --- history of lines -------------------------------------------------------------------------------------------------------------

_LINE = "struct<line:string,odds:string>"
_OC = f"struct<open:{_LINE},close:{_LINE}>"
_AMERICAN = "struct<american:string>"
_TEAM_ODDS = f"struct<moneyLine:int,spreadOdds:string,open:struct<moneyLine:{_AMERICAN},spread:{_AMERICAN},pointSpread:{_AMERICAN}>>"
_PICK = (
    f"provider struct<name:string>, details string, overUnder double, spread double, overOdds string, underOdds string, homeTeamOdds {_TEAM_ODDS}, awayTeamOdds {_TEAM_ODDS}, moneyline struct<home:{_OC},away:{_OC}>, pointSpread struct<home:{_OC},away:{_OC}>,"
    f" total struct<over:{_OC},under:{_OC}>, open struct<over:{_AMERICAN},under:{_AMERICAN},total:{_AMERICAN}>"
)


def pick_center(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and one row of opening and closing prices for each block (body) of a line history, whichever of its two layouts it has.

    A closing price comes from the block's top, else from its close at the same line. Two-way prices that can't be of one moment are
    unknown; the money line isn't held to that, as some are three-way.
    """
    b = blocks.select(*keep, F.from_json("body", _PICK).alias("b"))
    at = lambda path: F.col(f"b.{path}")
    price, first = american, lambda *c: F.coalesce(*c)

    def closing(top: str, sub: str, its_line: Column) -> Column:
        own = line(at(f"{sub}.close.line"))
        same = own.isNull() | its_line.isNull() | (F.abs(own - its_line) < 1e-9)
        return price(first(at(top), F.when(same, at(f"{sub}.close.odds"))))

    ou, spread = at("overUnder"), at("spread")
    made = {
        "provider": at("provider.name"), "home_ml": at("homeTeamOdds.moneyLine"), "away_ml": at("awayTeamOdds.moneyLine"), "spread": spread, "over_under": ou, "details": at("details"),
        "home_ml_open": price(first(at("moneyline.home.open.odds"), at("homeTeamOdds.open.moneyLine.american"))), "away_ml_open": price(first(at("moneyline.away.open.odds"), at("awayTeamOdds.open.moneyLine.american"))),
        "total_open": line(first(at("total.over.open.line"), at("total.under.open.line"), at("open.total.american"))), "over_price": closing("overOdds", "total.over", ou), "under_price": closing("underOdds", "total.under", ou),
        "over_price_open": price(first(at("total.over.open.odds"), at("open.over.american"))), "under_price_open": price(first(at("total.under.open.odds"), at("open.under.american"))),
        "spread_home_price": closing("homeTeamOdds.spreadOdds", "pointSpread.home", spread), "spread_away_price": closing("awayTeamOdds.spreadOdds", "pointSpread.away", -spread), "spread_open": line(first(at("pointSpread.home.open.line"), at("homeTeamOdds.open.pointSpread.american"))),
        "spread_home_price_open": price(first(at("pointSpread.home.open.odds"), at("homeTeamOdds.open.spread.american"))), "spread_away_price_open": price(first(at("pointSpread.away.open.odds"), at("awayTeamOdds.open.spread.american"))),
    }
    out = b.select(*keep, *[c.alias(n) for n, c in made.items()])
    for a, z in (("over_price", "under_price"), ("over_price_open", "under_price_open"), ("spread_home_price", "spread_away_price"), ("spread_home_price_open", "spread_away_price_open")):
        out = real_pair(out, a, z)
    return out


def real_pair(df: DataFrame, a: str, b: str, low: float = 1.0, high: float = 1.2) -> DataFrame:
    """Both prices become NULL where both are known and can't be of one moment; a price alone stays."""
    total = implied(F.col(a)) + implied(F.col(b))
    ok = F.col(a).isNull() | F.col(b).isNull() | total.between(low - 1e-9, high + 1e-9)
    return df.withColumns({f"__{a}": F.when(ok, F.col(a)), f"__{b}": F.when(ok, F.col(b))}).drop(a, b).withColumnsRenamed({f"__{a}": a, f"__{b}": b})


#: Names of player markets of two-sided lines.
TWO_SIDED = {"Total Points": "player_points", "Total Assists": "player_assists", "Total Goals": "player_goals", "Total Shots on Goal": "player_shots_on_goal", "Total Power Play Points": "player_power_play_points", "Total Blocked Shots": "player_blocked_shots", "Total Saves": "player_total_saves", "Total Hits": "player_hits"}
_TARGET = "struct<over:struct<value:string>,under:struct<value:string>,target:struct<value:string,displayValue:string>>"
_PROP = f"array<struct<type:struct<name:string>,athlete:struct<`$ref`:string>,odds:struct<american:struct<value:string,open:string>,total:struct<value:string,open:string>>,current:{_TARGET},open:{_TARGET},lastUpdated:string>>"
#: Fixed value: venues whose entries without a side come over first.
OVER_FIRST = ("draftkings",)


def prop_lines(bodies: DataFrame, yes: dict[str, str], milestones: dict[str, str]) -> DataFrame:
    """event_id, athlete_id, market, line, book, over and under prices (now and opening), updated of bodies (event_id, book, start, body: the array of entries).

    yes and milestones name the markets of one side (a price on yes; "3+" as the line 2.5). Entries without a side are paired where the
    venue lists over first and a line has just two. A price that wasn't last changed before the start is from during the game: it goes, and its line is the opening one. An
    opening price counts at the line it opened at. Of entries that clash, those whose line never moved come first.
    """
    kinds = {**{k: (v, "ou") for k, v in TWO_SIDED.items()}, **{k: (v, "yes") for k, v in yes.items()}, **{k: (v, "milestone") for k, v in milestones.items()}}
    of = lambda n: F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[n])]), F.col("e.type.name"))
    e = bodies.select("event_id", "book", "start", F.posexplode(F.from_json("body", _PROP)).alias("at", "e"))
    e = e.withColumns({"market": of(0), "kind": of(1), "athlete_id": F.regexp_extract("e.athlete.`$ref`", r"/athletes/(\d+)", 1).try_cast("long")}).filter("market IS NOT NULL AND athlete_id IS NOT NULL")
    has = lambda block, side: F.col(f"e.{block}.{side}").isNotNull()
    side = F.when(F.col("kind") != "ou", "over").when(has("current", "over"), "over").when(has("current", "under"), "under").when(has("open", "over"), "over").when(has("open", "under"), "under")
    at_line = lambda total, block: F.when(F.col("kind") == "yes", F.lit(0.5)).when(F.col("kind") == "milestone", milestone(F.coalesce(F.col(f"e.odds.total.{total}"), F.col(f"e.{block}.target.displayValue")))).otherwise(F.coalesce(line(F.col(f"e.odds.total.{total}")), line(F.col(f"e.{block}.target.value"))))
    e = e.withColumns({"side": side, "now": at_line("value", "current"), "then": at_line("open", "open"), "updated": instant(F.col("e.lastUpdated"))})
    # entries without a side: two of one line are over and under in their order
    pair = Window.partitionBy("event_id", "book", "athlete_id", "market", "now", F.col("side").isNull())
    alone = F.col("side").isNull() & F.lower(F.trim("book")).isin(*OVER_FIRST) & (F.count(F.lit(1)).over(pair) == 2)
    e = e.withColumn("side", F.when(alone, F.when(F.row_number().over(pair.orderBy("at")) == 1, "over").otherwise("under")).otherwise(F.col("side"))).filter("side IS NOT NULL")
    pregame, stayed = F.coalesce(F.col("updated") < F.col("start"), F.lit(False)), F.coalesce(F.abs(F.col("now") - F.col("then")) < 1e-9, F.lit(False))
    price, opening = american(F.col("e.odds.american.value")), american(F.col("e.odds.american.open"))
    e = e.withColumns({"line": F.round(F.when(pregame, F.col("now")).otherwise(F.col("then")), 1), "price": F.when(pregame, price), "opened": F.when(~pregame | stayed, opening), "moved": (~stayed).cast("int")}).filter("line IS NOT NULL")
    first = lambda s, c: F.min_by(c, F.when((F.col("side") == s) & F.col(c).isNotNull(), F.struct("moved", "at")))
    out = e.groupBy("event_id", "athlete_id", "market", "line", "book").agg(first("over", "price").alias("over_price"), first("under", "price").alias("under_price"), first("over", "opened").alias("over_price_open"), first("under", "opened").alias("under_price_open"), F.max("updated").alias("updated"))
    out = real_pair(real_pair(out, "over_price", "under_price"), "over_price_open", "under_price_open")
    return out.filter("coalesce(over_price, under_price, over_price_open, under_price_open) IS NOT NULL")


_ROSTER = "boxscore struct<players:array<struct<team:struct<displayName:string,abbreviation:string>,statistics:array<struct<athletes:array<struct<athlete:struct<id:string,displayName:string,shortName:string,position:struct<abbreviation:string>>>>>>>>>"


def roster(bodies: DataFrame, keep: list[str], positions: dict[str, str]) -> DataFrame:
    """keep columns, athlete_id, name, short_name, team, position: everyone who dressed, by game summaries (body); positions maps their abbreviations. Who is listed twice counts as last listed."""
    t = bodies.select(*keep, F.posexplode(F.from_json("body", _ROSTER)["boxscore"]["players"]).alias("t", "p"))
    g = t.select(*keep, "t", F.col("p.team.abbreviation").alias("team"), F.posexplode("p.statistics").alias("s", "g"))
    a = g.select(*keep, "t", "s", "team", F.posexplode("g.athletes").alias("k", "a")).filter(F.col("a.athlete.id").rlike(r"^\d+$"))
    place = F.create_map(*[F.lit(x) for kv in positions.items() for x in kv])
    one = F.struct(F.col("a.athlete.displayName").alias("name"), F.col("a.athlete.shortName").alias("short_name"), "team", F.try_element_at(place, F.upper(F.coalesce("a.athlete.position.abbreviation", F.lit("")))).alias("position"))
    by = a.groupBy(*keep, F.col("a.athlete.id").cast("long").alias("athlete_id")).agg(F.max_by(one, F.struct("t", "s", "k")).alias("r"))
    return by.select(*keep, "athlete_id", "r.*")


_COMBINATIONS = "props struct<pageProps:struct<combinations:struct<teamName:string,updatedAt:timestamp,players:array<struct<name:string,groupIdentifier:string,positionIdentifier:string,categoryIdentifier:string,injuryStatus:string,playerId:long,gameTimeDecision:boolean>>>>>"
#: Even-strength slots and the positions of who stands there.
SLOTS = {"lw": "L", "c": "C", "rw": "R", "ld": "D", "rd": "D", "g1": "G", "g2": "G"}


def lineups(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """keep columns, team_name, updated_at, unit, slot, player_name, position, injury_status, game_time_decision of line-up pages: the first player of a unit's slot; who has an even-strength slot has its position everywhere. Pages without line-ups give no rows."""
    c = embedded_json(pages, _COMBINATIONS, "__NEXT_DATA__", html, keep).select(*keep, F.col("data.props.pageProps.combinations").alias("c")).filter("c.players IS NOT NULL")
    # the list alone goes into the explosion: a page beside it would be copied for each of its players
    c = c.select(*keep, F.col("c.teamName").alias("team_name"), F.col("c.updatedAt").alias("updated_at"), F.col("c.players").alias("players"))
    p = c.select(*keep, "team_name", "updated_at", F.posexplode("players").alias("at", "p"))
    blank = lambda x: F.nullif(F.lower(F.trim(x)), F.lit(""))
    unit, slot = F.substring(F.upper(blank(F.col("p.groupIdentifier"))), 1, 6), F.substring(blank(F.col("p.positionIdentifier")), 1, 6)
    p = p.withColumns({"unit": unit, "slot": slot, "player_name": F.substring(F.nullif(F.trim("p.name"), F.lit("")), 1, 80)}).filter("unit IS NOT NULL AND slot IS NOT NULL AND player_name IS NOT NULL")
    even = F.when(F.col("p.categoryIdentifier") == "ev", F.try_element_at(F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv]), F.col("slot")))
    one = F.struct("player_name", F.col("p.playerId").alias("site_id"), even.alias("even"), F.substring(blank(F.col("p.injuryStatus")), 1, 12).alias("injury_status"), F.coalesce("p.gameTimeDecision", F.lit(False)).alias("game_time_decision"), "at")
    first = p.groupBy(*keep, "team_name", "updated_at", "unit", "slot").agg(F.min_by(one, "at").alias("r")).select(*keep, "team_name", "updated_at", "unit", "slot", "r.*")
    own = F.max_by("even", F.when(F.col("even").isNotNull(), F.col("at"))).over(Window.partitionBy(*keep, "player_name"))
    return first.withColumn("position", F.coalesce("even", own)).drop("even", "at")
