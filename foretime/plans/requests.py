"""Which snapshots to ask for: planned from a schedule, without those that were bought before, spread over what a budget reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.operators.ranking import bit_reversal
from foretime.operators.sequential import anchored_clusters

#: A close is asked for so long before the first start of a cluster, whose starts lie within the span of it.
CLOSE_LEAD, CLUSTER_SPAN = 10 * 60, 75 * 60
#: Local time of the morning's snapshot, and the zone.
MORNING_HOUR, MORNING_ZONE = 10, "America/Chicago"
#: What counts as bought, and the credits of a market in a region.
BOUGHT, CREDITS = ("ok", "empty", "paid_unparsed"), 10


def planned(games: DataFrame, purpose: str) -> DataFrame:
    """season, date, purpose, at (UTC seconds), n_games. games: season, date, start (timestamp); games without a start are left out.

    close: one before each cluster of a day's starts. morning: one at the local hour on days with a start after it.
    """
    known = games.filter(F.col("start").isNotNull()).select("season", "date", F.unix_seconds(F.col("start").cast("timestamp")).alias("s"))
    if purpose == "close":
        out = anchored_clusters(known, ["season", "date"], "s", CLUSTER_SPAN).select("season", "date", (F.col("first") - CLOSE_LEAD).alias("at"), F.col("members").alias("n_games"))
    elif purpose == "morning":
        local = F.make_timestamp(F.year("date"), F.month("date"), F.day("date"), F.lit(MORNING_HOUR), F.lit(0), F.lit(0), F.lit(MORNING_ZONE))
        rows = known.withColumn("at", F.unix_seconds(local)).filter(F.col("s") > F.col("at"))
        out = rows.groupBy("season", "date", "at").agg(F.count(F.lit(1)).alias("n_games"))
    else:
        raise ValueError(f"unknown purpose {purpose!r} (close or morning)")
    return out.withColumn("purpose", F.lit(purpose))


def _listed(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def covering(fetches: DataFrame, markets: str, bookmakers: str | None = None) -> DataFrame:
    """The logged fetches (status, markets, bookmakers) that were paid for and held every market asked for; with bookmakers, those of the same list only."""
    want = _listed(F.lit(markets))
    out = fetches.filter(F.col("status").isin(*BOUGHT) & (F.size(F.array_except(want, _listed(F.col("markets")))) == 0))
    return out if bookmakers is None else out.filter(_listed(F.col("bookmakers")) == _listed(F.lit(bookmakers)))


def with_coverage(plan: DataFrame, fetches: DataFrame) -> DataFrame:
    """plan with bought: whether a fetch (requested, snapshot, next_snapshot: UTC seconds) has what a request for `at` would return.

    That is the same request, or a snapshot that was the latest one at that time. Requests and fetches meet in one sorted pass for
    each day; what counts is the furthest reach of the fetches begun before, those of earlier days included.
    """
    fact = lambda t, kind, until: [t.alias("__t"), F.lit(kind).alias("__kind"), until.cast("long").alias("__until")]
    reach = fetches.filter("snapshot IS NOT NULL AND next_snapshot IS NOT NULL").select(*fact(F.col("snapshot"), 0, F.col("next_snapshot")))
    exact = fetches.filter("requested IS NOT NULL").select(*fact(F.col("requested"), 0, F.col("requested") + 1))
    asked = plan.select("at").distinct().select(*fact(F.col("at"), 1, F.lit(None)))
    facts = reach.unionByName(exact).unionByName(asked).withColumn("__day", F.floor(F.col("__t") / 86400))
    # how far the fetches of all earlier days reach: a row for each day
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = facts.groupBy("__day").agg(F.max("__until").alias("__until")).select("__day", F.max("__until").over(before).alias("__carried"))
    so_far = Window.partitionBy("__day").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = facts.withColumn("__reach", F.max("__until").over(so_far)).filter("__kind = 1").join(F.broadcast(days), "__day")
    furthest = F.greatest("__reach", "__carried")
    return plan.join(seen.select(F.col("__t").alias("at"), F.coalesce(furthest > F.col("__t"), F.lit(False)).alias("bought")), "at")


def ordered(plan: DataFrame) -> DataFrame:
    """plan with place: 0, 1, ... within a purpose and season, in an order of which every beginning is spread evenly over the season."""
    w = Window.partitionBy("purpose", "season")
    rows = plan.withColumn("__i", F.row_number().over(w.orderBy("date", "at")) - 1)
    # more bits than an index needs leave the order as it is
    return rows.withColumn("place", (F.row_number().over(w.orderBy(bit_reversal(F.col("__i"), 31))) - 1).cast("int")).drop("__i")


def described(plan: DataFrame, markets: str) -> DataFrame:
    """purpose, season, snapshots, days, games, bought, credits still to pay; plan has bought."""
    cost = CREDITS * len({m.strip() for m in markets.split(",") if m.strip()})
    left = F.count_if(~F.col("bought"))
    return plan.groupBy("purpose", "season").agg(F.count(F.lit(1)).alias("snapshots"), F.countDistinct("date").alias("days"), F.sum("n_games").alias("games"), F.count_if("bought").alias("bought"), (left * cost).alias("credits"))
