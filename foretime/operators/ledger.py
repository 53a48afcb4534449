"""Ledgers: results of legs, cash by day, balances, and how far to trust a model against the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.operators.keyed import merge_reports
from foretime.operators.sequential import allocate


def leg_result(market: Column, side: Column, line: Column, home: Column, away: Column, final: Column, void: Column) -> Column:
    """WIN, LOSS, PUSH or VOID of a leg; NULL while it is open.

    Markets: ml (home or away wins), pl (the line is added to the side's own margin), total (over or under the line).
    """
    margin = F.when(side == "home", home - away).when(side == "away", away - home).cast("double")
    total = (home + away).cast("double")
    ahead = (
        F.when(market == "ml", margin)
        .when(market == "pl", margin + line)
        .when((market == "total") & (side == "over"), total - line)
        .when((market == "total") & (side == "under"), line - total)
    )
    return F.when(void, "VOID").when(final, F.when(ahead > 0, "WIN").when(ahead < 0, "LOSS").when(ahead == 0, "PUSH"))


def daily_log(bets: DataFrame, key: str, day: str, stake: str, gain: str, start: float = 1000.0) -> DataFrame:
    """key, day, bets, staked, pnl, balance: days are summed before the running total, so a window holds one row for each day."""
    by = bets.groupBy(key, day).agg(F.count(F.lit(1)).alias("bets"), F.sum(stake).alias("staked"), F.sum(gain).alias("pnl"))
    so_far = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by.withColumn("balance", F.lit(start) + F.sum("pnl").over(so_far))


def balances(moves: DataFrame, slips: DataFrame, keys: list[str], kind: str, amount: str, gain: str) -> DataFrame:
    """keys, deposits, withdrawals, pnl, balance from two sources; a key of one source has 0 for the other."""
    of = lambda k: F.sum(F.when(F.col(kind) == k, F.col(amount))).alias(f"{k}s")
    both = merge_reports([moves.groupBy(*keys).agg(of("deposit"), of("withdrawal")), slips.groupBy(*keys).agg(F.sum(gain).alias("pnl"))], keys)
    return both.fillna(0.0, ["deposits", "withdrawals", "pnl"]).withColumn("balance", F.col("deposits") - F.col("withdrawals") + F.col("pnl"))


def trust(bets: DataFrame, model: str, market: str, won: str, points: int = 40, finer: int = 20) -> float:
    """The s in [0, 1] for which market + s * (model - market) makes the results likeliest.

    The log likelihood is concave in s, so the best of a coarse grid is within one step of the best of all, and a second
    pass looks there. A pass sums each grid point before its shuffle.
    """

    def best(grid: list[float]) -> float:
        s = F.explode(F.array(*[F.lit(x) for x in grid])).alias("s")
        each = bets.select(F.col(model).alias("p"), F.col(market).alias("m"), F.col(won).alias("y"), s)
        p = F.greatest(F.least(F.col("m") + F.col("s") * (F.col("p") - F.col("m")), F.lit(1 - 1e-6)), F.lit(1e-6))
        by = each.groupBy("s").agg(F.sum(F.when(F.col("y"), F.ln(p)).otherwise(F.ln(1 - p))).alias("ll"))
        return by.agg(F.min_by("s", F.struct(-F.col("ll"), F.col("s")))).first()[0]  # one number

    coarse = best([k / points for k in range(points + 1)])
    return best(sorted({min(max(coarse + k / (points * finer), 0.0), 1.0) for k in range(-finer, finer + 1)}))


def low_score_rho(low: DataFrame, bound: float = 0.2) -> float:
    """The rho in [-bound, bound], to three places, under which observed scores (y, z) are most likely, from the low cells p00, p01, p10, p11 and means m, n of their grids.

    The likelihood has one peak, so it is found in three passes, each one aggregation over all games for 21 candidates.
    """
    def likelihood(rho: float) -> Column:
        t = {c: F.greatest(x, F.lit(1e-12)) for c, x in (("00", 1 - F.col("m") * F.col("n") * rho), ("01", 1 + F.col("m") * rho), ("10", 1 + F.col("n") * rho), ("11", F.lit(1 - rho)))}
        seen = F.lit(1.0)
        for c, x in t.items():
            seen = F.when((F.col("y") == int(c[0])) & (F.col("z") == int(c[1])), x).otherwise(seen)
        return F.avg(F.ln(seen) - F.ln(1 + sum((F.col("p" + c) * (x - 1) for c, x in t.items()), F.lit(0.0))))

    low, best = low.persist(), 0
    for step, reach in ((20, 200), (2, 20), (1, 2)):  # thousandths
        tried = [k for k in range(best - reach, best + reach + 1, step) if abs(k) <= 1000 * bound]
        found = low.agg(*[likelihood(k / 1000).alias(str(k)) for k in tried]).first()
        best = max(tried, key=lambda k: found[str(k)])
    low.unpersist()
    return best / 1000


def total_calibration(df: DataFrame, pmf: str, total: str, most: int) -> DataFrame:
    """total, expected, observed, chi2: games by total, most and more as one, as PMFs say and as they were."""
    expected = df.select(F.posexplode(pmf).alias("t", "p")).groupBy(F.least("t", F.lit(most)).alias("total")).agg(F.sum("p").alias("e"))
    observed = df.groupBy(F.least(F.col(total), F.lit(most)).alias("total")).agg(F.count(F.lit(1)).alias("o"))
    both = expected.join(observed, "total", "left").withColumn("o", F.coalesce("o", F.lit(0)))
    return both.select("total", F.round("e", 6).alias("expected"), F.col("o").alias("observed"), F.round((F.col("o") - F.col("e")) ** 2 / F.greatest("e", F.lit(1e-9)), 5).alias("chi2"))


def problems(rules: list[tuple[Column, str]]) -> Column:
    """The messages of the rules that a row breaks, in order; an unknown condition isn't broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(said)) for broken, said in rules]))


def day_stakes(df: DataFrame, day: list[str], edge: str, kelly: str, order: list[str], part: float = 0.25, most: float = 0.02, day_cap: float = 0.1) -> DataFrame:
    """df with stake, a share of the day's first bankroll: a part of kelly trimmed to most; strongest edge first, a bet that would pass the day's cap is skipped and a smaller one later may still fit."""
    wished = df.withColumn("stake", F.least(F.col(kelly) * part, F.lit(most)))
    # without caps for items, any column serves as item
    kept = allocate(wished, day, order[0], edge, "stake", [-F.col(edge), *[F.col(c) for c in order]], daily=day_cap, per_item=float("inf"), most=2**62)
    return kept.withColumn("stake", F.when(F.col("kept"), F.col("stake")).otherwise(F.lit(0.0))).drop("kept")


def exposure(df: DataFrame, item: list[str], stake: str, placed: Column) -> DataFrame:
    """For each item: bets placed and what they stake, and whether it is frozen, that is, has one."""
    return df.groupBy(*item).agg(F.count_if(placed).alias("bets"), F.coalesce(F.sum(F.when(placed, F.col(stake))), F.lit(0.0)).alias("staked"), F.bool_or(placed).alias("frozen"))
