"""Slips as typed in, held against the model's chances; bets a strategy would have made, and what they brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions.prices import decide, decimal_odds, effective_decimal, implied, kelly
from foretime.operators.markets import add_fair
from foretime.operators.stats import edge_bucket

#: Least edges by market, the part of the Kelly stake, its cap, and where edges are cut.
LEAST_EDGE, PART, CAP = {"ml": 0.025, "total": 0.030}, 0.25, 0.02
CUTS = [0.025, 0.04, 0.06, 0.09]
#: A feed's price belongs to a paid snapshot from so many seconds before to so many after it.
PAIRED_BEFORE, PAIRED_AFTER = 30 * 60, 10 * 60


def parsed_legs(texts: DataFrame, spec: str = "spec") -> DataFrame:
    """texts with away, home, market (ml or total), side, line, price of "AWY@HOM ml side price" or "AWY@HOM total side line price"; fault says what is wrong with any other."""
    p = F.split(F.trim(F.regexp_replace(spec, r"[,\s]+", " ")), " ")
    at = lambda k: F.try_element_at(p, F.lit(k))
    teams = F.split(F.upper(at(1)), "@")
    market, n = F.lower(at(2)), F.size(p)
    price = F.when(market == "ml", at(4)).otherwise(at(5)).try_cast("int")
    line = F.when(market == "total", at(4).try_cast("double"))
    fault = (
        F.when(F.coalesce(F.size(teams), F.lit(0)) != 2, "teams").when(~F.coalesce(market.isin("ml", "total"), F.lit(False)), "market").when((market == "ml") & (n != 4) | (market == "total") & (n != 5), "length")
        .when(~F.upper(at(3)).isin("HOME", "AWAY", "OVER", "UNDER"), "side").when(price.isNull() | (market == "total") & line.isNull(), "number")
    )
    fine = lambda c: F.when(F.col("fault").isNull(), c)
    return texts.withColumn("fault", fault).withColumns({"away": fine(teams[0]), "home": fine(teams[1]), "market": fine(market), "side": fine(F.upper(at(3))), "line": fine(line), "price": fine(price)})


def with_games(legs: DataFrame, games: DataFrame, today: str) -> DataFrame:
    """legs (away, home, on) with game_id: of the day they name, else the next game of these sides from today on."""
    g = games.select("game_id", F.col("home"), F.col("away"), F.col("date").alias("__date"))
    same = g.filter(F.col("__date") >= F.lit(today).cast("date")).groupBy("home", "away").agg(F.min_by("game_id", F.struct("__date", "game_id")).alias("__next"))
    on = g.groupBy("home", "away", F.col("__date").alias("on")).agg(F.min("game_id").alias("__on"))
    out = legs.join(on, ["home", "away", "on"], "left").join(same, ["home", "away"], "left")
    return out.withColumn("game_id", F.when(F.col("on").isNotNull(), F.col("__on")).otherwise(F.col("__next"))).drop("__on", "__next")


def judged_legs(legs: DataFrame, unproven: tuple[str, ...] = ("total",)) -> DataFrame:
    """legs (market, price, p_win, p_push; NULL where the model says nothing) with ev, edge, verdict: BET, THIN (worth something, but under the least edge or of an unproven market), PASS, NO-MODEL. A push gives the stake back."""
    push = F.coalesce("p_push", F.lit(0.0))
    lose = 1 - F.col("p_win") - push
    ev = F.col("p_win") * (decimal_odds(F.col("price")) - 1) - lose
    edge = F.when(push > 0, F.col("p_win") / (F.col("p_win") + lose)).otherwise(F.col("p_win")) - implied(F.col("price"))
    least = F.when(F.col("market") == "total", LEAST_EDGE["total"]).otherwise(LEAST_EDGE["ml"])
    verdict = F.when(F.col("p_win").isNull(), "NO-MODEL").when(F.col("ev") <= 0, "PASS").when((F.col("edge") >= least) & ~F.col("market").isin(*unproven), "BET").otherwise("THIN")
    return legs.withColumns({"ev": ev, "edge": edge}).withColumn("verdict", verdict)


def judged_slips(legs: DataFrame, slip: str = "slip_id", offered: str = "offered") -> DataFrame:
    """slip, legs, p_all, ev, stake, verdict of slips whose legs are independent (rows of judged_legs with game_id and the slip's offered price or NULL).

    Two legs of one game are linked, so nothing is said (WITHHELD). A leg that may push counts with its stake back. BET asks for it of every leg.
    """
    product = lambda c: F.exp(F.sum(F.ln(c)))
    d, push = decimal_odds(F.col("price")), F.coalesce("p_push", F.lit(0.0))
    rows = legs.withColumns({"__d": d, "__m": F.col("p_win") * d + push})
    g = rows.groupBy(slip).agg(
        F.count(F.lit(1)).alias("legs"), F.countDistinct("game_id").alias("__games"), F.count_if(F.col("p_win").isNull()).alias("__unknown"), F.count_if(F.col("verdict") == "BET").alias("__bets"), F.max(offered).alias("__offered"),
        product("__d").alias("__fair"), product(F.when(F.col("p_win") > 0, F.col("p_win"))).alias("__all"), product(F.when(F.col("__m") > 0, F.col("__m"))).alias("__mult"), F.min("p_win").alias("__least"), F.min("__m").alias("__least_m"),
    )
    p_all, mult = F.when(F.col("__least") > 0, F.col("__all")).otherwise(0.0), F.when(F.col("__least_m") > 0, F.col("__mult")).otherwise(0.0)
    dec = F.coalesce(decimal_odds(F.col("__offered")), F.col("__fair"))
    ev = dec / F.col("__fair") * mult - 1
    told = (F.col("__unknown") == 0) & (F.col("__games") == F.col("legs"))
    stake = F.when(ev > 0, F.least(kelly(p_all, dec) * PART, F.lit(CAP))).otherwise(0.0)
    verdict = F.when(F.col("__unknown") > 0, "NO-MODEL").when(F.col("__games") < F.col("legs"), "WITHHELD").when(ev <= 0, "PASS").when(F.col("__bets") == F.col("legs"), "BET").otherwise("THIN")
    return g.select(slip, "legs", F.when(told, p_all).alias("p_all"), F.when(told, ev).alias("ev"), F.when(told, stake).alias("stake"), verdict.alias("verdict"))


def made_bets(games: DataFrame, fees: dict[str, float], edge_min: float = LEAST_EDGE["ml"], cap: float = CAP) -> DataFrame:
    """The bets a strategy makes on games (game_id, date, p, fair, home, away prices, home_book, away_book, fair_close, home_win): side, price, book, edge, stake, decimal after fees, won, flat_pnl of one unit, close_ev by the closing fair chance."""
    rows = games.filter("p IS NOT NULL AND fair IS NOT NULL").withColumn("d", decide(F.col("p"), F.col("fair"), F.col("home"), F.col("away"), edge_min, PART, cap)).filter("d IS NOT NULL")
    at_home = F.col("d.side") == "HOME"
    pick = lambda a, b: F.when(at_home, a).otherwise(b)
    price, book = pick(F.col("home"), F.col("away")), pick(F.col("home_book"), F.col("away_book"))
    won = F.col("home_win") == at_home
    out = rows.withColumns({"side": F.col("d.side"), "price": price, "book": book, "edge": F.col("d.edge"), "stake": F.col("d.stake"), "decimal": effective_decimal(price, F.coalesce(book, F.lit("")), fees), "won": won, "p_close": pick(F.col("fair_close"), 1 - F.col("fair_close"))})
    return out.withColumns({"flat_pnl": F.when(F.col("won"), F.col("decimal") - 1).otherwise(-1.0), "close_ev": F.col("p_close") * F.col("decimal") - 1}).select("game_id", "date", "side", "price", "book", "edge", "stake", "decimal", "won", "flat_pnl", "p_close", "close_ev")


def bet_summary(bets: DataFrame, cuts: list[float] = CUTS) -> DataFrame:
    """For each bucket of the edge and for all (bucket NULL): bets, hit rate, mean edge, flat return, closing value with its error, and the share that beat the close."""
    rows = bets.withColumn("bucket", edge_bucket(F.col("edge") + 1e-12, cuts))
    return rows.rollup("bucket").agg(
        F.count(F.lit(1)).alias("bets"), F.avg(F.col("won").cast("double")).alias("hit_rate"), F.avg("edge").alias("avg_edge"), F.avg("flat_pnl").alias("flat_roi"), F.avg("close_ev").alias("close_ev"), (F.stddev_samp("close_ev") / F.sqrt(F.count("close_ev"))).alias("close_ev_se"), F.avg((F.col("close_ev") > 0).cast("double")).alias("beat_close")
    )


def feed_moves(paid: DataFrame, feed: DataFrame, since: Column | None = None) -> DataFrame:
    """game_id, verdict, venues, move: how far free prices moved since the last paid snapshot. paid: game_id, at; feed: game_id, venue, at, home, away (at in seconds).

    Before is the last price of a venue around the paid snapshot; now is its last one after that, or from `since` on. unknown_before and
    unknown_now say that a move can't be ruled out.
    """
    last = paid.groupBy("game_id").agg(F.max("at").alias("__paid"))
    rows = add_fair(feed.filter("home IS NOT NULL AND away IS NOT NULL")).join(last, "game_id", "right")
    edge = F.col("__paid") + PAIRED_AFTER
    is_before = F.col("at").between(F.col("__paid") - PAIRED_BEFORE, edge)
    is_now = (F.col("at") > edge) if since is None else (F.col("at") >= since) & (F.col("at") >= F.col("__paid") - PAIRED_BEFORE)
    by = rows.groupBy("game_id", "venue").agg(F.max_by("fair_home", F.when(is_before, F.col("at"))).alias("was"), F.max_by("fair_home", F.when(is_now, F.col("at"))).alias("is"))
    gap = F.abs(F.col("is") - F.col("was"))
    out = by.groupBy("game_id").agg(F.count("was").alias("__was"), F.count("is").alias("__is"), F.count(gap).alias("venues"), F.max(gap).alias("move"))
    return out.select("game_id", F.when(F.col("__is") == 0, "unknown_now").when(F.col("__was") == 0, "unknown_before").otherwise("known").alias("verdict"), "venues", "move")


def rescore_plan(news: DataFrame, open_games: DataFrame, frozen: DataFrame, moves: DataFrame, threshold: float) -> DataFrame:
    """game_id, date, may_pick of games with news that haven't begun and have no pick yet; only where the price is known not to have moved may there be a new one."""
    rows = news.select("game_id").distinct().join(open_games.select("game_id", "date"), "game_id").join(frozen.select("game_id"), "game_id", "left_anti")
    return rows.join(moves.select("game_id", "verdict", "move"), "game_id", "left").select("game_id", "date", F.coalesce((F.col("verdict") == "known") & (F.col("move") < threshold), F.lit(False)).alias("may_pick"))


def frozen_games(picks: DataFrame) -> DataFrame:
    """Games with a money-line pick that wasn't voided: they are never decided again."""
    return picks.filter((F.col("market") == "ml") & ~F.coalesce("voided", F.lit(False))).select("game_id").distinct()
