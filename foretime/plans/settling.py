"""Settlement as plans over whole tables: what is due is decided, what was decided stays, so settling twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions.prices import american_odds, closing_value, decimal_odds, effective_decimal, fair, implied, void_reason
from foretime.sources.versions import Versions

#: Venues that charge a fee on the price, and its coefficient.
FEES = {"kalshi": 0.07, "polymarket": 0.0695}


def due_bets(recommendations: DataFrame, games: DataFrame) -> DataFrame:
    """Issued bets (rec_id, game_id, side, book, price, stake, fair_prob, priced_at, created_at, scheduled_start, status) that aren't settled and whose game is over, postponed or cancelled."""
    over = F.col("game_state").isin("FINAL", "OFF") & F.col("home_score").isNotNull()
    g = games.select("game_id", "date", "start", "schedule_state", "home_score", "away_score", F.coalesce(over, F.lit(False)).alias("is_final"))
    return recommendations.filter(F.col("status") != "SETTLED").join(g, "game_id").filter(F.col("is_final") | F.col("schedule_state").isin("PPD", "CNCL"))


def closing_quotes(bets: DataFrame, quotes: DataFrame) -> DataFrame:
    """rec_id, closing_price, closing_prob: the last quote after the bet was priced and before the start.

    That of the bet's own book has a price; without it the median of all books' fair chances stands in. quotes: game_id, book, captured_at,
    home_price, away_price. An unknown start or pricing time doesn't bound the window.
    """
    b = bets.select("rec_id", "game_id", "side", F.col("book").alias("own"), "priced_at", "start")
    q = quotes.filter(F.col("home_price").isNotNull() & F.col("away_price").isNotNull())
    open_ = (F.col("priced_at").isNull() | (F.col("captured_at") > F.col("priced_at"))) & (F.col("start").isNull() | (F.col("captured_at") < F.col("start")))
    # a game has few bets; quotes are cut to the last of each book before anything else
    last = b.join(q, "game_id").filter(open_).groupBy("rec_id", "side", "own", "book").agg(F.max_by(F.struct("home_price", "away_price"), "captured_at").alias("q"))
    home = F.col("side") == "HOME"
    price = F.when(home, F.col("q.home_price")).otherwise(F.col("q.away_price"))
    by = last.groupBy("rec_id", "side").agg(F.max(F.when(F.col("book") == F.col("own"), price)).alias("closing_price"), F.median(fair(F.col("q.home_price"), F.col("q.away_price"))).alias("__home"))
    consensus = F.when(home, F.col("__home")).otherwise(1 - F.col("__home"))
    return by.select("rec_id", "closing_price", F.when(F.col("closing_price").isNotNull(), implied(F.col("closing_price"))).otherwise(consensus).alias("closing_prob"))


def settled_bets(due: DataFrame, quotes: DataFrame, fees: dict[str, float] = FEES) -> DataFrame:
    """rec_id, game_id, date, book, price, stake, placed_at, result, pnl, closing_price, clv: due bets decided. A void one returns its stake and has no closing value."""
    df = due.join(closing_quotes(due, quotes), "rec_id", "left")
    why = void_reason(F.col("schedule_state"), F.col("start"), F.col("scheduled_start"), F.col("is_final"), F.coalesce("priced_at", "created_at"))
    df = df.withColumn("void", why.isNotNull()).withColumn("won", (F.col("home_score") > F.col("away_score")) == (F.col("side") == "HOME"))
    gain = F.when(F.col("won"), F.col("stake") * (effective_decimal(F.col("price"), F.col("book"), fees) - 1)).otherwise(-F.col("stake"))
    clv = closing_value(F.col("closing_price"), F.col("price"), F.col("closing_prob"), F.col("fair_prob"))
    stands = lambda c: F.when(~F.col("void"), c)
    return df.select(
        "rec_id", "game_id", "date", "book", "price", "stake", F.coalesce("priced_at", "created_at").alias("placed_at"), F.when(F.col("void"), "VOID").when(F.col("won"), "WIN").otherwise("LOSS").alias("result"),
        F.when(F.col("void"), 0.0).otherwise(F.round(gain, 2)).alias("pnl"), stands(F.col("closing_price")).alias("closing_price"), stands(clv).alias("clv"),
    )


def settle_bets(tables: Versions, games: DataFrame, quotes: DataFrame) -> int:
    """Settle what is due of the tables recommendations and bets, and switch both to the new version at once."""

    def change(now: Versions) -> dict[str, DataFrame]:
        recommendations, bets = now.read("recommendations"), now.read("bets")
        new = settled_bets(due_bets(recommendations, games), quotes).join(bets.select("rec_id"), "rec_id", "left_anti")
        done = new.select("rec_id").withColumn("__done", F.lit(True))
        status = F.when(F.col("__done"), "SETTLED").otherwise(F.col("status"))
        return {"bets": bets.unionByName(new.select(*bets.columns)), "recommendations": recommendations.join(done, "rec_id", "left").withColumn("status", status).select(*recommendations.columns)}

    return tables.update(change)


def leg_outcome(market: Column, side: Column, line: Column, home: Column, away: Column, final: Column, schedule_state: Column, shots: Column, box_loaded: Column) -> Column:
    """WIN, LOSS, PUSH or VOID of a leg of a slip; NULL while it can't be decided.

    ml, pl, total, and prop_sog: a player's shots over or under the line once the box score is there; one without a row didn't play and
    is void. Other markets are settled by hand; a tied final is a fault of the data and decides nothing.
    """
    up, home_side = F.upper(side), F.upper(side) == "HOME"
    compare = lambda value, over: F.when(value == 0, "PUSH").when((value > 0) == over, "WIN").otherwise("LOSS")
    margin = F.when(home_side, home - away).otherwise(away - home)
    scored = final & home.isNotNull() & away.isNotNull()
    ml = F.when(home != away, F.when((home > away) == home_side, "WIN").otherwise("LOSS"))
    prop = F.when(box_loaded, F.when(shots.isNull(), "VOID").otherwise(compare(shots - line, up == "OVER")))
    decided = F.when(market == "ml", ml).when(market == "pl", compare(margin + line, F.lit(True))).when(market == "total", compare(home + away - line, up == "OVER")).when(market == "prop_sog", prop)
    unknown = F.raise_error(F.concat(F.lit("unknown market "), market)).cast("string")
    return F.when(~market.isin("ml", "pl", "total", "prop_sog", "other"), unknown).when(market == "other", F.lit(None)).when(schedule_state.isin("PPD", "CNCL"), "VOID").when(scored, decided)


def decided_legs(legs: DataFrame, games: DataFrame, box: DataFrame) -> DataFrame:
    """legs (slip_id, leg_no, game_id, player_id, market, side, line, price, result) with the results that can be told by now; those that have one keep it. box: game_id, player_id, shots."""
    loaded = box.select("game_id").distinct().withColumn("__box", F.lit(True))
    over = F.coalesce(F.col("game_state").isin("FINAL", "OFF"), F.lit(False))
    rows = legs.join(games.select("game_id", "home_score", "away_score", "schedule_state", over.alias("__final")), "game_id", "left").join(loaded, "game_id", "left").join(box.select("game_id", "player_id", "shots"), ["game_id", "player_id"], "left")
    told = leg_outcome(F.col("market"), F.col("side"), F.col("line"), F.col("home_score"), F.col("away_score"), F.coalesce("__final", F.lit(False)), F.col("schedule_state"), F.col("shots"), F.coalesce("__box", F.lit(False)))
    return rows.withColumn("result", F.coalesce("result", told)).select(*legs.columns)


def slip_results(slips: DataFrame, legs: DataFrame) -> DataFrame:
    """slips (slip_id, stake, price, is_bonus, status, payout) with status and payout of open ones from their legs.

    A lost leg loses the slip; else it waits for all. Pushed and void legs drop out: the slip's price is divided by their own, and
    without that it stays open. A slip that was sold at the product of its legs' prices is paid the product of those that won. A
    bonus pays its profit only, and nothing back.
    """
    one = F.struct("leg_no", "result", "price")
    by = legs.groupBy("slip_id").agg(F.sort_array(F.collect_list(one)).alias("__legs"))  # a slip has a few legs
    of = lambda f: F.filter("__legs", f)
    product = lambda x: F.aggregate(x, F.lit(1.0), lambda a, leg: a * decimal_odds(leg["price"]))
    some = lambda f: F.coalesce(F.exists("__legs", f), F.lit(False))
    dropped, won = of(lambda x: x["result"].isin("PUSH", "VOID")), of(lambda x: x["result"] == "WIN")
    lost, waits, live = some(lambda x: F.coalesce(x["result"] == "LOSS", F.lit(False))), some(lambda x: x["result"].isNull()), F.size(won) > 0
    unknown = F.exists(dropped, lambda x: x["price"].isNull())
    standard = (F.size("__legs") > 1) & ~some(lambda x: x["price"].isNull()) & F.coalesce(american_odds(product(F.col("__legs"))) == F.col("price"), F.lit(False))
    factor = F.when(standard, product(won)).otherwise(decimal_odds(F.col("price")) / product(dropped))
    all_void = F.forall("__legs", lambda x: x["result"] == "VOID")
    status = F.when(lost, "LOST").when(waits | F.col("__legs").isNull(), "OPEN").when(~live, F.when(all_void, "VOID").otherwise("PUSH")).when(unknown, "OPEN").otherwise("WON")
    bonus, stake = F.col("is_bonus"), F.col("stake").cast("double")
    paid = F.when(F.col("__status") == "LOST", 0.0).when(F.col("__status").isin("PUSH", "VOID"), F.when(bonus, 0.0).otherwise(F.round(stake, 2))).when(F.col("__status") == "WON", F.round(stake * (factor - F.when(bonus, 1.0).otherwise(0.0)), 2))
    out = slips.join(by, "slip_id", "left").withColumn("__status", F.when(F.col("status") == "OPEN", status).otherwise(F.col("status"))).withColumn("__paid", F.when(F.col("status") == "OPEN", paid).otherwise(F.col("payout")))
    return out.withColumns({"status": F.col("__status"), "payout": F.col("__paid")}).select(*slips.columns)


def settle_slips(tables: Versions, games: DataFrame, box: DataFrame) -> int:
    """Decide open legs and slips of the tables slips and legs, and switch both at once."""

    def change(now: Versions) -> dict[str, DataFrame]:
        legs = decided_legs(now.read("legs"), games, box)
        return {"legs": legs, "slips": slip_results(now.read("slips"), legs)}

    return tables.update(change)
