"""Time-on-ice reports: HTML pages read by a row generator, matched to players by sweater."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_HEADING = re.compile(r'class="playerHeading[^"]*"[^>]*>\s*(\d+)\s+[^<]*<', re.I)
_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S), re.compile(r"<td\b[^>]*>(.*?)</td>", re.I | re.S)
_BOTH_CLOCKS = re.compile(r"\d{1,2}:\d{2}\s*/\s*\d{1,2}:\d{2}")
_CLOCK = re.compile(r"([0-9]{1,2}):([0-9]{2})")


def _text(cell: str) -> str:
    if "<" in cell:
        cell = re.sub(r"<[^>]+>", " ", cell)
    return " ".join((html.unescape(cell) if "&" in cell else cell).split())


def _seconds(clock: str) -> int | None:
    m = _CLOCK.fullmatch(clock)
    return int(m[1]) * 60 + int(m[2]) if m else None


@udtf(returnType="sweater int, number string, period string, start int, end int, length int")
class ReportRows:
    """The table rows of one team's report that have a clock (elapsed / left) as their start, each with the sweater of the heading above. Totals under a player have no such clock."""

    def eval(self, page: str):
        if not page:
            return
        # re.split with one group: text before, then sweater and its part in turn
        parts = _HEADING.split(page)
        for sweater, part in zip(parts[1::2], parts[2::2]):
            for row in _ROW.findall(part):
                cells = [_text(c) for c in _CELL.findall(row)]
                if len(cells) >= 5 and _BOTH_CLOCKS.fullmatch(cells[2]):
                    end = _seconds(cells[3].split("/")[0].strip()) if _BOTH_CLOCKS.fullmatch(cells[3]) else None
                    yield int(sweater), cells[0], cells[1].upper(), _seconds(cells[2].split("/")[0].strip()), end, _seconds(cells[4])


def report_shifts(pages: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """keep columns and sweater, shift_number, period (OT is 4), start, end, duration in seconds: a row for each shift of the reports; a missing duration is end minus start."""
    # the generator's argument names the column of the row that it is joined to
    rows = pages.select(*keep, F.col(page).alias("__page")).lateralJoin(ReportRows(F.col("__page").outer()))
    return rows.select(
        *keep, "sweater", F.col("number").try_cast("int").alias("shift_number"), F.when(F.col("period") == "OT", 4).otherwise(F.col("period").try_cast("int")).alias("period"), "start", "end", F.coalesce("length", F.when(F.col("end") >= F.col("start"), F.col("end") - F.col("start"))).alias("duration")
    ).filter("period IS NOT NULL")


_PLAYER = "array<struct<playerId:long,sweaterNumber:int>>"
_SIDE = f"struct<forwards:{_PLAYER},defense:{_PLAYER},goalies:{_PLAYER}>"
_SWEATERS = f"homeTeam struct<abbrev:string>, awayTeam struct<abbrev:string>, playerByGameStats struct<homeTeam:{_SIDE},awayTeam:{_SIDE}>"


def sweaters(boxscores: DataFrame, game: str = "game_id", body: str = "body") -> DataFrame:
    """game, side (H or V), sweater, player_id, team of box scores (JSON); of a number given twice the last in the order forwards, defense, goalies counts."""
    b = boxscores.select(game, F.from_json(body, _SWEATERS).alias("b"))
    group = lambda side, letter, k, role: F.struct(F.lit(letter).alias("side"), F.lit(k).alias("k"), F.nullif(F.col(f"b.{side}.abbrev"), F.lit("")).alias("team"), F.coalesce(F.col(f"b.playerByGameStats.{side}.{role}"), F.from_json(F.lit("[]"), _PLAYER)).alias("players"))
    rows = b.select(game, F.inline(F.array(*[group(s, x, k, r) for s, x in (("homeTeam", "H"), ("awayTeam", "V")) for k, r in enumerate(("forwards", "defense", "goalies"))])))
    each = rows.select(game, "side", "k", "team", F.posexplode("players").alias("at", "p")).filter("p.playerId IS NOT NULL AND p.sweaterNumber IS NOT NULL")
    last = F.max_by(F.struct(F.col("p.playerId").alias("player_id"), "team"), F.struct("k", "at"))
    return each.groupBy(game, "side", F.col("p.sweaterNumber").alias("sweater")).agg(last.alias("r")).select(game, "side", "sweater", "r.player_id", "r.team")


def player_shifts(pages: DataFrame, boxscores: DataFrame, game: str = "game_id") -> DataFrame:
    """Shifts of both reports of a game (game, side, html) with player_id and team by the box score; a sweater it doesn't have leaves them NULL. Of a player's shifts with one start the one with the highest number stays."""
    # a game's pages meet its list of sweaters, so that shifts needn't be sent to theirs; every page is read once
    who = F.struct(F.struct("side", "sweater"), F.struct("player_id", "team"))
    lists = sweaters(boxscores, game).groupBy(game).agg(F.map_from_entries(F.collect_list(who)).alias("__who"))
    rows = report_shifts(pages.join(lists, game, "left"), [game, "side", "__who"])
    rows = rows.withColumn("__found", F.try_element_at("__who", F.struct("side", "sweater")))
    out = rows.select(game, "__found.player_id", "period", "start", "end", "duration", "__found.team", "shift_number", "side", "sweater")
    best = Window.partitionBy(game, "player_id", "period", "start").orderBy(F.coalesce("shift_number", F.lit(-1)).desc(), *[F.col(c).desc_nulls_last() for c in ("end", "duration", "side", "sweater")])
    return out.withColumn("__k", F.row_number().over(best)).filter("player_id IS NULL OR __k = 1").drop("__k")
