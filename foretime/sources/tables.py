"""Schemas and readers of files: schemas are declared, never inferred, and NaN stops here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.functions.guards import nan_to_null
from foretime.functions.text import american, clock_seconds, fraction

#: The tables of the driver's star schema.
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

EVENT_FILE = (
    "shot_id long, season int, game_id int, home_team string, away_team string, team string, period int, time int, event string, "
    "x double, y double, shot_type string, shooter_id long, goalie_id long, skaters_home int, skaters_away int, home_score int, away_score int, goal int, xg double"
)
QUOTE_SNAPSHOT = (
    "struct<timestamp:string,previous_timestamp:string,next_timestamp:string,data:array<struct<id:string,commence_time:string,home_team:string,away_team:string,"
    "bookmakers:array<struct<key:string,last_update:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>>>>"
)
CANDLES = "struct<candlesticks:array<struct<end_period_ts:long,open:double,high:double,low:double,close:double,volume:double>>>"
SHIFTS = "struct<data:array<struct<id:long,gameId:long,playerId:long,period:int,startTime:string,endTime:string,duration:string,teamAbbrev:string,typeCode:int,shiftNumber:int>>>"
INJURIES = "struct<injuries:array<struct<team:string,athletes:array<struct<id:string,name:string,status:string,date:string>>>>>"
PROPS = "struct<id:string,commence_time:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,description:string,price:int,point:double>>>>>>>"


def driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_file(spark: SparkSession, path: str, known_games: DataFrame | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """Event rows of a CSV with header: whole game ids from year and number, team codes without points and with renamed applied, events other than SHOT, GOAL, MISS as SHOT, strength from the shooter's side, and only known games."""
    raw = nan_to_null(spark.read.schema(EVENT_FILE).option("header", True).csv(path))
    code = lambda c: _renamed(F.regexp_replace(F.col(c), r"\.", ""), renamed or {})
    home_shot = F.col("team") == F.lit("HOME")
    out = raw.select(
        "shot_id",
        "season",
        (F.col("season").cast("long") * 1_000_000 + F.col("game_id")).alias("game_id"),
        code("home_team").alias("home_team"),
        code("away_team").alias("away_team"),
        F.when(home_shot, code("home_team")).otherwise(code("away_team")).alias("team"),
        "period",
        "time",
        F.when(F.col("event").isin("SHOT", "GOAL", "MISS"), F.col("event")).otherwise("SHOT").alias("event"),
        "x",
        "y",
        F.coalesce("shot_type", F.lit("WRIST")).alias("shot_type"),
        "shooter_id",
        "goalie_id",
        F.when(home_shot, F.concat_ws("v", "skaters_home", "skaters_away")).otherwise(F.concat_ws("v", "skaters_away", "skaters_home")).alias("strength"),
        (F.col("home_score") - F.col("away_score")).alias("score_state"),
        (F.col("goal") == 1).alias("is_goal"),
        "xg",
    )
    return out.join(known_games.select("game_id"), "game_id", "left_semi") if known_games is not None else out


def _renamed(c: Column, names: dict[str, str]) -> Column:
    out = c
    for old, new in names.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def json_bodies(spark: SparkSession, path: str) -> DataFrame:
    """path and body of whole files, gzipped ones too: raw copies of what an API sent."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def quotes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """A row for each price of a snapshot: snapshot_ts, previous_ts, next_ts, event_id, starts_at, home, away, venue, market, side, price, point, updated_at. Events that have begun at the snapshot are left out."""
    one = bodies.select(F.from_json(body, QUOTE_SNAPSHOT).alias("s"))
    ts = lambda c: F.try_to_timestamp(c)
    e = one.select(ts("s.timestamp").alias("snapshot_ts"), ts("s.previous_timestamp").alias("previous_ts"), ts("s.next_timestamp").alias("next_ts"), F.explode("s.data").alias("e"))
    b = e.select("*", F.explode("e.bookmakers").alias("b"))
    m = b.select("*", F.explode("b.markets").alias("m"))
    o = m.select("*", F.explode("m.outcomes").alias("o"))
    side = (
        F.when(F.col("o.name") == F.col("e.home_team"), "home")
        .when(F.col("o.name") == F.col("e.away_team"), "away")
        .otherwise(F.lower("o.name"))
    )
    out = o.select(
        "snapshot_ts",
        "previous_ts",
        "next_ts",
        F.col("e.id").alias("event_id"),
        ts("e.commence_time").alias("starts_at"),
        F.col("e.home_team").alias("home"),
        F.col("e.away_team").alias("away"),
        F.col("b.key").alias("venue"),
        F.col("m.key").alias("market"),
        side.alias("side"),
        F.round("o.price").cast("int").alias("price"),
        F.col("o.point").cast("decimal(4,1)").alias("point"),
        ts("b.last_update").alias("updated_at"),
    )
    return out.filter("starts_at > snapshot_ts")


def prop_quotes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """event_id, starts_at, venue, market, player, line, over, under: both sides of a line in one row."""
    e = bodies.select(F.from_json(body, PROPS).alias("e"))
    m = e.select("e.id", "e.commence_time", F.explode("e.bookmakers").alias("b")).select("*", F.explode("b.markets").alias("m"))
    o = m.select(F.col("id").alias("event_id"), F.try_to_timestamp("commence_time").alias("starts_at"), F.col("b.key").alias("venue"), F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    side = lambda s: F.max(F.when(F.lower("o.name") == s, F.col("o.price"))).alias(s)
    return o.groupBy("event_id", "starts_at", "venue", "market", F.col("o.description").alias("player"), F.col("o.point").alias("line")).agg(side("over"), side("under"))


def candles(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, end_ts and prices of candles; of several for one end the last of the body."""
    each = bodies.select(key, F.posexplode(F.from_json(body, CANDLES)["candlesticks"]).alias("k", "c"))
    fields = ("open", "high", "low", "close", "volume")
    return each.groupBy(key, F.timestamp_seconds("c.end_period_ts").alias("end_ts")).agg(*[F.max_by(f"c.{f}", "k").alias(f) for f in fields])


def shifts(bodies: DataFrame, game: str = "game_id", body: str = "body") -> DataFrame:
    """game_id, player_id, period, start, end, duration (seconds), team, shift_id, goal: rows of other games go; of a player's shifts with one start the lowest id stays; a missing duration is end minus start."""
    each = bodies.select(game, F.inline(F.from_json(body, SHIFTS)["data"])).filter(F.col("gameId") == F.col(game))
    start, end = clock_seconds(F.col("startTime")), clock_seconds(F.col("endTime"))
    rows = each.select(
        game,
        F.col("playerId").alias("player_id"),
        "period",
        start.alias("start"),
        end.alias("end"),
        F.when(clock_seconds(F.col("duration")) > 0, clock_seconds(F.col("duration"))).otherwise(end - start).alias("duration"),
        F.col("teamAbbrev").alias("team"),
        F.col("id").alias("shift_id"),
        (F.col("typeCode") == 505).alias("goal"),
    ).filter("player_id IS NOT NULL AND period IS NOT NULL")
    values = ["end", "duration", "team", "shift_id", "goal"]
    best = F.min_by(F.struct(*values), F.coalesce("shift_id", F.lit(2**63 - 1)))
    return rows.groupBy(game, "player_id", "period", "start").agg(best.alias("r")).select(game, "player_id", "period", "start", "r.*")


def injuries(bodies: DataFrame, day: str = "day", body: str = "body") -> DataFrame:
    """day, team, athlete_id, name, status, since: a row for each athlete."""
    each = bodies.select(day, F.inline(F.from_json(body, INJURIES)["injuries"])).select(day, "team", F.inline("athletes"))
    return each.select(day, "team", F.regexp_extract("id", r"(\d+)$", 1).try_cast("long").alias("athlete_id"), "name", F.lower("status").alias("status"), F.try_to_timestamp("date").alias("since"))


def html_rows(pages: DataFrame, html: str = "html", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """keep columns, row_no and cells (array<string>, tags removed) of every table row of a page."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"&nbsp;|&#160;", " "), r"\s+", " "))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), clean)
    return pages.select(*keep, F.posexplode(rows).alias("row_no", "row")).select(*keep, "row_no", cells(F.col("row")).alias("cells"))


def embedded_json(pages: DataFrame, schema: str, script_id: str, html: str = "html", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """keep columns and data, the JSON of a page's script element."""
    body = F.regexp_extract(html, rf'(?is)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)
    return pages.select(*keep, F.from_json(body, schema).alias("data")).filter("data IS NOT NULL")


def box_lines(df: DataFrame, saves: str, toi: str) -> DataFrame:
    """saves, shots_against and toi_seconds from "19/21" and "MM:SS"."""
    f = fraction(F.col(saves))
    return df.withColumns({"saves": f["made"], "shots_against": f["tried"], "toi_seconds": clock_seconds(F.col(toi))})


def priced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Price columns in any spelling as ints."""
    return df.withColumns({c: american(F.col(c)) for c in columns})


_SIDE = "struct<abbrev:string,score:int>"
_WEEK = f"gameWeek array<struct<date:string,games:array<struct<id:long,season:int,gameType:int,gameState:string,gameScheduleState:string,startTimeUTC:timestamp,homeTeam:{_SIDE},awayTeam:{_SIDE},gameOutcome:struct<lastPeriodType:string>,periodDescriptor:struct<number:int,periodType:string>>>>>"
_PLAYERS = "array<struct<playerId:long,goals:int,toi:string,saveShotsAgainst:string>>"
_ROLES = f"struct<forwards:{_PLAYERS},defense:{_PLAYERS},goalies:{_PLAYERS}>"
_BOX = f"homeTeam struct<abbrev:string>, awayTeam struct<abbrev:string>, playerByGameStats struct<homeTeam:{_ROLES},awayTeam:{_ROLES}>"


def schedule(bodies: DataFrame, season: int | None = None) -> DataFrame:
    """A row for each regular-season and playoff game of weekly schedules (body: JSON). Scores and how a game ended are known once it is over; the season comes from the id where the game doesn't state it."""
    g = bodies.select(F.inline(F.from_json("body", _WEEK)["gameWeek"])).select("date", F.explode("games").alias("g")).filter("g.gameType IN (2, 3)")
    first = F.floor(F.col("g.id") / 1000000).cast("int")
    over = F.col("g.gameState").isin("FINAL", "OFF")
    plain = F.when((F.col("g.periodDescriptor.number") > 3) & (F.coalesce("g.periodDescriptor.periodType", F.lit("REG")) == "REG"), "OT").otherwise(F.coalesce("g.periodDescriptor.periodType", F.lit("REG")))
    last = F.coalesce("g.gameOutcome.lastPeriodType", plain)
    out = g.select(
        F.col("g.id").alias("game_id"), F.coalesce("g.season", first * 10000 + first + 1).alias("season"), F.col("g.gameType").alias("game_type"), "date", F.col("g.homeTeam.abbrev").alias("home_team"), F.col("g.awayTeam.abbrev").alias("away_team"),
        F.when(over, F.col("g.homeTeam.score")).alias("home_score"), F.when(over, F.col("g.awayTeam.score")).alias("away_score"), F.col("g.gameState").alias("game_state"), F.when(over, last.isin("OT", "SO")).alias("is_ot"), F.when(over, last == "SO").alias("is_so"),
    )
    return out if season is None else out.filter(F.col("season") == season)


def boxscore(bodies: DataFrame) -> DataFrame:
    """A row for each player of box scores (game_id, body: JSON), with seconds of play and, for goalies, saves and shots."""
    from foretime.functions.text import clock_seconds, fraction

    b = bodies.select("game_id", F.from_json("body", _BOX).alias("b"))
    group = lambda side, role: F.struct(F.col(f"b.{side}.abbrev").alias("team"), F.lit(role).alias("role"), F.col(f"b.playerByGameStats.{side}.{role}").alias("players"))
    rows = b.select("game_id", F.inline(F.array(*[group(side, role) for side in ("homeTeam", "awayTeam") for role in ("forwards", "defense", "goalies")])))
    rows = rows.select("game_id", "team", "role", F.explode("players").alias("p"))
    shots = fraction(F.col("p.saveShotsAgainst"))
    goalie = F.col("role") == "goalies"
    return rows.select(
        "game_id", "team", F.col("p.playerId").alias("player_id"), "role", F.col("p.goals").alias("goals"), clock_seconds(F.col("p.toi")).alias("toi_seconds"), F.when(goalie, shots["made"]).alias("saves"), F.when(goalie, shots["tried"]).alias("shots_against")
    )
