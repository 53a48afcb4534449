"""Quotes of several venues: consensus, best prices, arbitrage, middles, and checks of the quotes themselves.

Quotes are rows (item, venue, side columns with prices, ts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions.prices import decimal_odds, fair, implied
from foretime.operators.pit import top_row


def add_fair(df: DataFrame, home: str = "home", away: str = "away") -> DataFrame:
    """fair_home and overround of two-sided quotes."""
    return df.withColumns({"fair_home": fair(F.col(home), F.col(away)), "overround": implied(F.col(home)) + implied(F.col(away)) - 1})


def consensus(df: DataFrame, item: list[str], venue: str = "venue") -> DataFrame:
    """For each item: the median fair price, how many venues, and each side's best price with its venue, of equal prices the first by name."""
    q = add_fair(df)

    def best(side: str) -> list[Column]:
        order = F.struct(-decimal_odds(F.col(side)), F.col(venue))
        return [F.min_by(side, order).alias(f"best_{side}"), F.min_by(venue, order).alias(f"best_{side}_venue")]

    return q.groupBy(*item).agg(F.median("fair_home").alias("fair_home"), F.count_distinct(venue).alias("venues"), *best("home"), *best("away"))


def main_line(df: DataFrame, item: list[str], line: str = "line", over: str = "over", under: str = "under", venue: str = "venue") -> DataFrame:
    """The line most venues have, of equal ones the nearest to even, then the lowest; with the median fair chance of over."""
    by = df.withColumn("fair_over", fair(F.col(over), F.col(under))).groupBy(*item, line).agg(F.count_distinct(venue).alias("venues"), F.median("fair_over").alias("fair_over"))
    return top_row(by, item, [F.desc("venues"), F.abs(F.col("fair_over") - 0.5), F.col(line)])


def arbitrages(df: DataFrame, item: list[str], venue: str = "venue", least: float = 0.001) -> DataFrame:
    """Items whose best prices on both sides give a sure profit: profit = 1 / (1 / a + 1 / b) - 1, and the share of the stake on each side."""
    c = consensus(df, item, venue)
    a, b = decimal_odds(F.col("best_home")), decimal_odds(F.col("best_away"))
    return c.withColumns({"profit": 1 / (1 / a + 1 / b) - 1, "home_share": (1 / a) / (1 / a + 1 / b)}).filter(F.col("profit") >= least)


def middles(df: DataFrame, item: list[str], line: str = "line", over: str = "over", under: str = "under", venue: str = "venue") -> DataFrame:
    """Pairs of an over and an under of one item with over's line below under's.

    Only the best price of each line takes part, so an item makes as many rows as it has lines, whatever its quotes.
    """
    best = lambda side: df.filter(F.col(side).isNotNull()).groupBy(*item, line).agg(F.max(decimal_odds(F.col(side))).alias(f"dec_{side}"), F.min_by(venue, F.struct(-decimal_odds(F.col(side)), F.col(venue))).alias(f"{side}_venue"))
    o = best(over).withColumnRenamed(line, "low")
    u = best(under).withColumnRenamed(line, "high")
    return o.join(u, item).filter("low < high").withColumn("gap", F.col("high") - F.col("low"))


def leave_one_out(df: DataFrame, item: list[str], value: str = "fair_home", venue: str = "venue") -> DataFrame:
    """others_median: the median of the item's other venues, and others: how many. An item's quotes are one for each venue, so the array is small."""
    by = df.groupBy(*item).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(venue).alias("b")))).alias("all"))
    out = df.join(by, item).withColumn("rest", F.transform(F.filter("all", lambda x: x["b"] != F.col(venue)), lambda x: x["v"]))
    n = F.size("rest")
    mid = (F.try_element_at("rest", F.floor((n + 1) / 2).cast("int")) + F.try_element_at("rest", F.floor((n + 2) / 2).cast("int"))) / 2
    return out.withColumns({"others": n, "others_median": F.when(n > 0, mid)}).drop("all", "rest")


def swapped_venues(df: DataFrame, item: list[str], venue: str = "venue", least: int = 2, clear: float = 0.02) -> DataFrame:
    """Venues whose sides look swapped: where at least two others are clearly on one side of even, the venue is on the other side at least `least` times and at least every second time."""
    q = leave_one_out(add_fair(df), item, "fair_home", venue).filter((F.col("others") >= 2) & (F.abs(F.col("others_median") - 0.5) >= clear))
    against = (F.signum(F.col("fair_home") - 0.5) != F.signum(F.col("others_median") - 0.5)).cast("long")
    return q.groupBy(venue).agg(F.count(F.lit(1)).alias("judged"), F.sum(against).alias("against")).filter((F.col("against") >= least) & (2 * F.col("against") >= F.col("judged")))


def in_play(home: Column, away: Column, total: Column) -> Column:
    """Whether a two-sided quote can't be one from before the start: a price of 1000 or more, implied chances under 0.75 together, or a total under 5 or from 8 on."""
    long_ = (F.abs(home) >= 1000) | (F.abs(away) >= 1000)
    return F.coalesce(long_, F.lit(False)) | F.coalesce(implied(home) + implied(away) < 0.75, F.lit(False)) | F.coalesce((total < 5) | (total >= 8), F.lit(False))


def sane_pair(df: DataFrame, a: str, b: str, low: float = 1.0, high: float = 1.2) -> DataFrame:
    """Both prices become NULL where their implied chances don't sum to [low, high]."""
    ok = (implied(F.col(a)) + implied(F.col(b))).between(low, high)
    return df.withColumns({a: F.when(ok, F.col(a)), b: F.when(ok, F.col(b))})


def price_move(before: DataFrame, now: DataFrame, item: list[str], threshold: float, venue: str = "venue") -> DataFrame:
    """The largest change of the fair price among venues that quote at both times, and whether it reaches threshold."""
    b = add_fair(before).select(*item, venue, F.col("fair_home").alias("was"))
    n = add_fair(now).select(*item, venue, F.col("fair_home").alias("is"))
    return b.join(n, [*item, venue]).groupBy(*item).agg(F.max(F.abs(F.col("is") - F.col("was"))).alias("move"), F.count(F.lit(1)).alias("venues")).withColumn("moved", F.col("move") >= threshold)


def latest_with_fallback(fresh: DataFrame, archive: DataFrame, item: list[str], ts: str, asof: str, hours: float, venue: str = "venue", home: str = "home", away: str = "away") -> DataFrame:
    """The latest two-sided quote of each item and venue in the hours up to asof; items without one take the archive's quotes that aren't in-play."""
    t = F.lit(asof).cast("timestamp")
    two_sided = F.col(home).isNotNull() & F.col(away).isNotNull()
    recent = fresh.filter(two_sided & F.col(ts).between(t - F.make_dt_interval(hours=F.lit(int(hours))), t)).groupBy(*item, venue).agg(F.max_by(F.struct(home, away), ts).alias("q"))
    recent = recent.select(*item, venue, f"q.{home}", f"q.{away}")
    old = archive.filter(two_sided & ~in_play(F.col(home), F.col(away), F.col("total"))).select(*item, venue, home, away)
    return recent.unionByName(old.join(recent.select(*item).distinct(), item, "left_anti"))


def median_line(df: DataFrame, item: list[str], ts: str, asof: str, hours: float, line: str = "line", venue: str = "venue") -> DataFrame:
    """The median over venues of the latest line of each in the hours up to asof."""
    t = F.lit(asof).cast("timestamp")
    recent = df.filter(F.col(line).isNotNull() & F.col(ts).between(t - F.make_dt_interval(hours=F.lit(int(hours))), t))
    return recent.groupBy(*item, venue).agg(F.max_by(line, ts).alias(line)).groupBy(*item).agg(F.median(line).alias(line))


def tied_best(df: DataFrame, item: list[str], price: str, venue: str = "venue") -> DataFrame:
    """item, price, venues: the best price and all venues that offer it, by name. Venues of an item are few."""
    d = df.filter(F.col(price).isNotNull()).withColumn("__d", F.round(decimal_odds(F.col(price)), 12))
    top = d.groupBy(*item).agg(F.max("__d").alias("__d"))
    return d.join(top, [*item, "__d"]).groupBy(*item).agg(F.min(price).alias(price), F.sort_array(F.collect_set(venue)).alias("venues"))


def pregame_pair(over: Column, under: Column, open_over: Column, open_under: Column, updated: Column, start: Column) -> Column:
    """struct(over, under, source) of a two-sided price from before the start: the current one if it was updated before, else the opening one; NULL without either. Prices under 100 in size are none."""
    fine = lambda a, b: (F.abs(a) >= 100) & (F.abs(b) >= 100)
    pair = lambda a, b, source: F.struct(a.alias("over"), b.alias("under"), F.lit(source).alias("source"))
    return F.when((updated < start) & fine(over, under), pair(over, under, "current")).when(fine(open_over, open_under), pair(open_over, open_under, "open"))


def matched_props(props: DataFrame, predictions: DataFrame, played: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """props with the predictions of their keys and matched, or the reason why there is none: no_player_id, did_not_play, not_eligible (under least games before) or other."""
    out = props.join(predictions.withColumn("__hit", F.lit(True)), keys, "left").join(played.select(*keys, "n_prior").dropDuplicates(keys), keys, "left")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    reason = F.when(F.col("__hit"), "matched").when(missing, "no_player_id").when(F.col("n_prior").isNull(), "did_not_play").when(F.col("n_prior") < least, "not_eligible").otherwise("other")
    return out.withColumn("reason", reason).drop("__hit", "n_prior")
