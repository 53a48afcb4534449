"""Queries of prices, settlement and same-game chances on the driver's tables, and the same in SQL.

Suppliers stand for games with scoring rates of their own, orders for bets and quotes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foretime.functions import grids, pmf, prices
from foretime.operators import ledger
from foretime.plans.queries import query, r6, spread
from foretime.sources.tables import driver_table

#: Weights of margins 0 to 3 and of 4 and more.
MARGINS = [1.154, 0.508, 0.7228, 1.3429, 1.0]

RATES = """
rates AS (SELECT s_suppkey AS k, 2.0 + (s_suppkey % 17) / 10.0 AS lh, 1.8 + (s_suppkey % 13) / 10.0 AS la, 0.35 + (s_suppkey % 7) / 20.0 AS p, 5.5 + (s_suppkey % 3) / 2.0 AS line FROM supplier),
raw AS (SELECT k, side, g, exp(-l) * l ** g / gamma(g + 1) AS m FROM (SELECT k, 'h' AS side, CAST(lh AS DOUBLE) AS l FROM rates UNION ALL SELECT k, 'a', CAST(la AS DOUBLE) FROM rates), (SELECT unnest(range(13)) AS g)),
one AS (SELECT k, side, g, m / sum(m) OVER (PARTITION BY k, side) AS m FROM raw),
means AS (SELECT k, sum(g * m) FILTER (WHERE side = 'h') AS mh, sum(g * m) FILTER (WHERE side = 'a') AS ma FROM one GROUP BY k),
weighed AS (SELECT x.k, CAST(x.g AS INT) AS h, CAST(y.g AS INT) AS a, x.m * y.m * (CASE least(abs(x.g - y.g), 4) WHEN 0 THEN 1.154 WHEN 1 THEN 0.508 WHEN 2 THEN 0.7228 WHEN 3 THEN 1.3429 ELSE 1.0 END) AS w, mh, ma
  FROM one x JOIN one y ON x.k = y.k AND x.side = 'h' AND y.side = 'a' JOIN means ON means.k = x.k),
cells AS (SELECT k, h, a, w / sum(w) OVER (PARTITION BY k) AS p, mh, ma FROM weighed)"""


def _rates(spark, d):
    k = F.col("s_suppkey")
    return spread(driver_table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select(
        k.alias("k"), (2.0 + F.pmod(k, F.lit(17)) / 10).alias("lh"), (1.8 + F.pmod(k, F.lit(13)) / 10).alias("la"), (0.35 + F.pmod(k, F.lit(7)) / 20).alias("p"), (5.5 + F.pmod(k, F.lit(3)) / 2).alias("line")
    )


def _grid(rho=0.0):
    return grids.grid(pmf.poisson(F.col("lh")), pmf.poisson(F.col("la")), MARGINS, rho)


@query(
    f"""WITH {RATES}, f AS (SELECT k, h, a, p * greatest(CASE WHEN h = 0 AND a = 0 THEN 1 - mh * ma * 0.05 WHEN h = 0 AND a = 1 THEN 1 + mh * 0.05 WHEN h = 1 AND a = 0 THEN 1 + ma * 0.05 WHEN h = 1 AND a = 1 THEN 1 - 0.05 ELSE 1 END, 0) AS w FROM cells),
c AS (SELECT k, h, a, w / sum(w) OVER (PARTITION BY k) AS p FROM f)
SELECT k, round(sum(p) FILTER (WHERE h = 0 AND a = 0), 6) AS p00, round(sum(p) FILTER (WHERE h = 1 AND a = 0), 6) AS p10, round(sum(p) FILTER (WHERE h = 1 AND a = 1), 6) AS p11, round(sum(p) FILTER (WHERE h = a), 6) AS tie, round(sum(p * (h + a)), 6) AS goals FROM c GROUP BY k"""
)
def low_score_grid(spark, d):
    g = _rates(spark, d).select("k", _grid(0.05).alias("g"))
    at = lambda x, y: grids.mass(F.col("g"), lambda h, a: (h == x) & (a == y))
    goals = F.aggregate("g", F.lit(0.0), lambda s, c: s + c["p"] * (c["h"] + c["a"]))
    return g.select("k", r6(at(0, 0), "p00"), r6(at(1, 0), "p10"), r6(at(1, 1), "p11"), r6(grids.mass(F.col("g"), lambda h, a: h == a), "tie"), r6(goals, "goals"))


OBSERVED = "h = CAST(k % 3 AS INT) AND a = CAST((k // 3) % 3 AS INT)"


@query(
    f"""WITH {RATES}, low AS (SELECT k, max(mh) AS m, max(ma) AS n, max(p) FILTER (WHERE h = 0 AND a = 0) AS p00, max(p) FILTER (WHERE h = 0 AND a = 1) AS p01, max(p) FILTER (WHERE h = 1 AND a = 0) AS p10, max(p) FILTER (WHERE h = 1 AND a = 1) AS p11 FROM cells GROUP BY k),
lattice AS (SELECT (unnest(range(401)) - 200) / 1000.0::DOUBLE AS rho),
t AS (SELECT rho, k % 3 AS y, (k // 3) % 3 AS z, greatest(1 - m * n * rho, 1e-12) AS t00, greatest(1 + m * rho, 1e-12) AS t01, greatest(1 + n * rho, 1e-12) AS t10, greatest(1 - rho, 1e-12) AS t11, p00, p01, p10, p11 FROM low, lattice),
l AS (SELECT rho, avg(ln(CASE WHEN y = 0 AND z = 0 THEN t00 WHEN y = 0 AND z = 1 THEN t01 WHEN y = 1 AND z = 0 THEN t10 WHEN y = 1 AND z = 1 THEN t11 ELSE 1 END) - ln(1 + p00 * (t00 - 1) + p01 * (t01 - 1) + p10 * (t10 - 1) + p11 * (t11 - 1))) AS ll FROM t GROUP BY rho)
SELECT round(arg_max(rho, ll), 3) AS rho FROM l"""
)
def low_score_fit(spark, d):
    """The most likely rho of observed scores, to three places."""
    at = lambda x, y: grids.mass(F.col("g"), lambda h, a: (h == x) & (a == y))
    low = _rates(spark, d).select("k", pmf.mean(pmf.poisson(F.col("lh"))).alias("m"), pmf.mean(pmf.poisson(F.col("la"))).alias("n"), _grid().alias("g")).select(
        "m", "n", F.pmod("k", F.lit(3)).alias("y"), F.pmod(F.floor(F.col("k") / 3), F.lit(3)).alias("z"), at(0, 0).alias("p00"), at(0, 1).alias("p01"), at(1, 0).alias("p10"), at(1, 1).alias("p11")
    )
    return spark.createDataFrame([(ledger.low_score_rho(low),)], "rho double")


FINAL = f"""WITH {RATES}, f AS (SELECT k, h, a, p FROM cells WHERE h <> a UNION ALL SELECT k, h + 1, a, p * 0.52 FROM cells WHERE h = a UNION ALL SELECT k, h, a + 1, p * (1 - 0.52) FROM cells WHERE h = a),
m AS (SELECT f.k, p, h > a AS w1, h + a > line AS w2, h + a = line AS u2, h - a - 1.5 > 0 AS w3, a < 3 AS w4, a = 3 AS u4 FROM (SELECT f.*, rates.line FROM f JOIN rates USING (k)) f)"""


@query(
    FINAL
    + """
SELECT k, round(coalesce(sum(p) FILTER (WHERE w1 AND w2 AND w3 AND w4), 0), 6) AS p_all_win, round(sum(p) FILTER (WHERE w1) * sum(p) FILTER (WHERE w2) * sum(p) FILTER (WHERE w3) * sum(p) FILTER (WHERE w4), 6) AS p_independent,
  round(sum(p * (CASE WHEN w1 THEN 1.8 ELSE 0 END) * (CASE WHEN w2 THEN 1.9 WHEN u2 THEN 1 ELSE 0 END) * (CASE WHEN w3 THEN 2.6 ELSE 0 END) * (CASE WHEN w4 THEN 1.7 WHEN u4 THEN 1 ELSE 0 END)), 6) AS multiplier, round(sum(p), 6) AS total FROM m GROUP BY k"""
)
def same_game_price(spark, d):
    g = _rates(spark, d).select("k", "line", grids.final_scores(_grid(), F.lit(0.52)).alias("f"))
    legs = [grids.leg("ml", "HOME"), grids.leg("total", "OVER", F.col("line")), grids.leg("spread", "HOME", F.lit(-1.5)), grids.leg("team_total", "UNDER", F.lit(3.0), "AWAY")]
    priced = g.select("k", grids.price_legs(F.col("f"), legs, [F.lit(x) for x in (1.8, 1.9, 2.6, 1.7)]).alias("x"), grids.mass(F.col("f")).alias("total"))
    return priced.select("k", r6(F.col("x.p_all_win"), "p_all_win"), r6(F.col("x.p_independent"), "p_independent"), r6(F.col("x.multiplier"), "multiplier"), r6(F.col("total"), "total"))


@query(f"WITH {RATES} SELECT k, round(p, 5) AS over_chance, round(p, 5) AS home_chance, 0.0 AS moved_within_total, 0.0 AS total_moved, round(0.5 + 0.15 * (p - 0.5), 6) AS overtime FROM rates")
def tilted_grid(spark, d):
    """The two tilts by what defines them: the chances they aim at, and what they leave alone."""
    t = lambda h, a: grids.settled_total(h, a)
    g = _rates(spark, d).withColumn("g", _grid()).withColumn("q", grids.overtime_share(F.col("p")))
    g = g.withColumn("x", grids.tilt_total(F.col("g"), F.col("p"), F.col("line"))).withColumn("y", grids.tilt_margin(F.col("x"), F.col("p"), F.col("q")))
    share = lambda c: grids.mass(c, lambda h, a: (h == 4) & (a == 2)) / grids.mass(c, lambda h, a: t(h, a) == 6)
    six = lambda c: grids.mass(c, lambda h, a: t(h, a) == 6)
    return g.select(
        "k",
        F.round(grids.over_without_push(F.col("x"), F.col("line")), 5).alias("over_chance"),
        F.round(grids.home_win(F.col("y"), F.col("q")), 5).alias("home_chance"),
        F.abs(r6(share(F.col("x")) - share(F.col("g")), "x")).alias("moved_within_total"),
        F.abs(r6(six(F.col("x")) - six(F.col("y")), "y")).alias("total_moved"),
        r6(F.col("q"), "overtime"),
    )


@query(f"WITH {RATES} SELECT k, round(p, 5) AS over_chance FROM rates")
def market_rates(spark, d):
    """The rates at which the model's own total has the market's chance of over."""
    g = _rates(spark, d).withColumn("c", grids.market_scale(F.col("lh"), F.col("la"), F.col("p"), F.col("line"), MARGINS))
    return g.select("k", F.round(grids.over_without_push(grids.grid(pmf.poisson(F.col("lh") * F.col("c")), pmf.poisson(F.col("la") * F.col("c")), MARGINS), F.col("line")), 5).alias("over_chance"))


@query(
    f"""WITH {RATES}, t AS (SELECT k, least(h + a + CASE WHEN h = a THEN 1 ELSE 0 END, 10) AS t, sum(p) AS p FROM cells GROUP BY 1, 2), e AS (SELECT t, sum(p) AS expected FROM t GROUP BY t), o AS (SELECT CAST(k % 11 AS INT) AS t, count(*) AS observed FROM rates GROUP BY 1)
SELECT CAST(r.t AS INT) AS total, round(coalesce(expected, 0), 6) AS expected, coalesce(observed, 0) AS observed, round((coalesce(observed, 0) - coalesce(expected, 0)) ** 2 / greatest(coalesce(expected, 0), 1e-9), 5) AS chi2 FROM (SELECT unnest(range(11)) AS t) r LEFT JOIN e USING (t) LEFT JOIN o USING (t)"""
)
def total_calibration(spark, d):
    """Expected and observed games by total, 10 and more as one."""
    return ledger.total_calibration(_rates(spark, d).select(pmf.total_of(pmf.joint(pmf.poisson(F.col("lh")), pmf.poisson(F.col("la")), MARGINS)).alias("pmf"), F.pmod("k", F.lit(11)).cast("int").alias("total")), "pmf", "total", 10)


@query(
    """WITH x AS (SELECT s_suppkey AS k, 1.5 + (s_suppkey % 21) / 10.0::DOUBLE AS mu, s_suppkey % 9 AS y, 0.5 + s_suppkey % 5 AS line FROM supplier),
m AS (SELECT k, mu, y, line, g, exp(lgamma(g + 1 / 0.12) - lgamma(1 / 0.12) - lgamma(g + 1) + g * ln(mu * 0.12 / (1 + mu * 0.12)) - ln(1 + mu * 0.12) / 0.12) AS w FROM x, (SELECT unnest(range(16)) AS g)),
p AS (SELECT k, mu, y, line, g, w / sum(w) OVER (PARTITION BY k) AS p FROM m)
SELECT k, round(coalesce(sum(p) FILTER (WHERE g > line), 0), 6) AS over_chance, round(-ln(max(p) FILTER (WHERE g = y)), 6) AS nll, round(sum(p * g), 6) AS mean FROM p GROUP BY k"""
)
def negative_binomial_mass(spark, d):
    k = F.col("s_suppkey")
    x = driver_table(spark, d, "supplier").select(k.alias("k"), (1.5 + F.pmod(k, F.lit(21)) / 10).alias("mu"), F.pmod(k, F.lit(9)).alias("y"), (0.5 + F.pmod(k, F.lit(5))).alias("line"))
    x = x.withColumn("m", pmf.negative_binomial(F.col("mu"), 0.12))
    return x.select("k", r6(pmf.over(F.col("m"), F.col("line")), "over_chance"), r6(pmf.nll(F.col("m"), F.col("y")), "nll"), r6(pmf.mean(F.col("m")), "mean"))


BETS = """
bets AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN -(105 + o_orderkey % 90) ELSE 100 + o_orderkey % 130 END AS price,
  CASE WHEN o_orderkey % 3 = 0 THEN -(101 + o_orderkey % 70) ELSE 101 + o_orderkey % 110 END AS other, 0.3 + (o_orderkey % 41) / 100.0::DOUBLE AS p, 10.0 + o_orderkey % 25 AS stake,
  CASE o_orderkey % 4 WHEN 0 THEN 'kalshi' WHEN 1 THEN 'polymarket' ELSE 'book' || CAST(o_orderkey % 5 AS VARCHAR) END AS venue FROM orders)"""


def _bets(spark, d):
    k = F.col("o_orderkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    venue = F.when(mod(4) == 0, "kalshi").when(mod(4) == 1, "polymarket").otherwise(F.concat(F.lit("book"), mod(5).cast("string")))
    return driver_table(spark, d, "orders").select(
        k.alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("day"), F.when(mod(2) == 0, -(105 + mod(90))).otherwise(100 + mod(130)).alias("price"),
        F.when(mod(3) == 0, -(101 + mod(70))).otherwise(101 + mod(110)).alias("other"), (0.3 + mod(41) / 100).alias("p"), (10.0 + mod(25)).alias("stake"), venue.alias("venue"),
    )


IMPLIED = "CASE WHEN {0} < 0 THEN -{0} / (100.0 - {0}) ELSE 100.0 / (100 + {0}) END"
DECIMAL = "CASE WHEN {0} < 0 THEN 1 - 100.0 / {0} ELSE 1 + {0} / 100.0 END"


@query(
    f"""WITH {BETS}, q AS (SELECT *, {IMPLIED.format("price")} AS q, {DECIMAL.format("price")} AS dec FROM bets),
f AS (SELECT *, CASE venue WHEN 'kalshi' THEN 0.07 WHEN 'polymarket' THEN 0.0695 ELSE 0 END * q * (1 - q) AS fee FROM q),
e AS (SELECT *, CASE WHEN venue IN ('kalshi', 'polymarket') THEN 1 / (q + fee) ELSE dec END AS eff FROM f)
SELECT k, round(fee, 6) AS fee, round(eff, 6) AS effective, round(p * eff - 1, 6) AS value, round(greatest(((eff - 1) * p - (1 - p)) / (eff - 1), 0), 6) AS kelly, round(q + {IMPLIED.format("other")} - 1, 6) AS overround FROM e"""
)
def exchange_prices(spark, d):
    """Prices after the fee of the venues that charge one."""
    fees = {"kalshi": 0.07, "polymarket": 0.0695}
    b = _bets(spark, d).withColumn("eff", prices.effective_decimal(F.col("price"), F.col("venue"), fees))
    return b.select(
        "k", r6(prices.exchange_fee(F.col("venue"), prices.implied(F.col("price")), fees), "fee"), r6(F.col("eff"), "effective"), r6(prices.expected_value(F.col("p"), F.col("eff")), "value"),
        r6(prices.kelly(F.col("p"), F.col("eff")), "kelly"), r6(prices.overround(F.col("price"), F.col("other")), "overround"),
    )


@query(
    f"""WITH {BETS}, s AS (SELECT *, CASE WHEN k % 11 = 0 THEN NULL ELSE k % 2 = 0 END AS won, CASE k % 13 WHEN 0 THEN 'PPD' WHEN 1 THEN 'CNCL' ELSE 'OK' END AS state, CASE WHEN k % 17 > 0 THEN k % 9 END AS moved, k % 60 AS issued, k % 6 > 0 AS final FROM bets)
SELECT k, round(CASE WHEN won IS NULL THEN 0 WHEN won THEN stake * ({DECIMAL.format("price")} - 1) ELSE -stake END, 6) AS profit,
  CASE WHEN state = 'PPD' THEN 'ppd' WHEN state = 'CNCL' THEN 'cncl' WHEN NOT final THEN NULL WHEN moved IS NOT NULL THEN CASE WHEN abs(moved - 4) > 3 THEN 'moved' END WHEN issued > 36 THEN 'moved' END AS void,
  round(CASE WHEN k % 5 > 0 THEN {IMPLIED.format("other")} - {IMPLIED.format("price")} ELSE p - 0.5 END, 4) AS clv FROM s"""
)
def settlements(spark, d):
    """Profit, reason to void and closing-line value of each bet."""
    k = F.col("k")
    mod = lambda n: F.pmod(k, F.lit(n))
    b = _bets(spark, d).withColumns({
        "won": F.when(mod(11) != 0, mod(2) == 0), "state": F.when(mod(13) == 0, "PPD").when(mod(13) == 1, "CNCL").otherwise("OK"), "start": F.to_timestamp("day"), "final": mod(6) > 0,
    })
    b = b.withColumns({"scheduled": F.when(mod(17) > 0, F.timestamp_seconds(F.unix_seconds("start") + (mod(9) - 4) * 3600)), "issued": F.timestamp_seconds(F.unix_seconds("start") - mod(60) * 3600)})
    close = F.when(mod(5) > 0, F.col("other"))
    return b.select(
        "k", r6(prices.profit(F.col("won"), F.col("stake"), prices.decimal_odds(F.col("price"))), "profit"), prices.void_reason(F.col("state"), F.col("start"), F.col("scheduled"), F.col("final"), F.col("issued")).alias("void"),
        prices.closing_value(close, F.col("price"), F.col("p"), F.lit(0.5)).alias("clv"),
    )


SLIPS = f"""legs AS (SELECT k, c, stake, k % 7 = 0 AS bonus, {DECIMAL.format("price")} AS dec, CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN 'VOID' WHEN k % 29 = 0 THEN 'PUSH' WHEN k % 3 = 0 THEN 'LOSS' ELSE 'WIN' END AS result, k // 8 AS slip FROM bets)"""


@query(
    f"""WITH {BETS}, {SLIPS}, s AS (SELECT slip, min(stake) AS stake, bool_or(bonus) AS bonus, bool_or(result = 'LOSS') AS lost, bool_or(result IS NULL) AS waits, bool_or(result = 'WIN') AS live, product(CASE WHEN result = 'WIN' THEN dec ELSE 1 END) AS factor FROM legs GROUP BY slip),
t AS (SELECT *, CASE WHEN lost THEN 'LOST' WHEN waits THEN 'OPEN' WHEN live THEN 'WON' ELSE 'PUSH' END AS status FROM s)
SELECT slip, status, round(factor, 6) AS factor, round(CASE status WHEN 'WON' THEN stake * (factor - 1) WHEN 'LOST' THEN CASE WHEN bonus THEN 0 ELSE -stake END WHEN 'PUSH' THEN 0 END, 6) AS cash FROM t"""
)
def slip_outcomes(spark, d):
    """Slips of a few legs each: the legs of a slip are few, so they meet in an array."""
    k = F.col("k")
    mod = lambda n: F.pmod(k, F.lit(n))
    result = F.when(mod(19) == 0, None).when(mod(23) == 0, "VOID").when(mod(29) == 0, "PUSH").when(mod(3) == 0, "LOSS").otherwise("WIN")
    leg = F.struct(prices.decimal_odds(F.col("price")).alias("dec"), result.alias("result"))
    s = _bets(spark, d).groupBy(F.floor(k / 8).alias("slip")).agg(F.min("stake").alias("stake"), F.bool_or(mod(7) == 0).alias("bonus"), F.sort_array(F.collect_list(leg)).alias("legs"))
    s = s.withColumn("x", prices.parlay(F.col("legs.dec"), F.col("legs.result")))
    return s.select("slip", F.col("x.status").alias("status"), r6(F.col("x.factor"), "factor"), r6(prices.slip_cash(F.col("x.status"), F.col("stake"), F.col("x.factor"), F.col("bonus")), "cash"))


@query(
    f"""WITH {BETS}, x AS (SELECT * REPLACE (CAST(stake AS DOUBLE) * 1.0137931 AS stake), {DECIMAL.format("price")} AS d1, {DECIMAL.format("other")} AS d2 FROM bets), h AS (SELECT *, stake * (d1 - 1) / d2 AS fb, stake * (d1 - 0.7) / d2 AS rf, stake * (1 + (d1 - 1) * 1.3) / d2 AS pb FROM x)
SELECT k, round(fb, 4) AS free_hedge, round(fb * (d2 - 1), 4) AS free_profit, round(rf, 4) AS risk_hedge, round(stake * (d1 - 1) - rf, 4) AS risk_profit, round(pb, 4) AS boost_hedge, round(stake * (d1 - 1) * 1.3 - pb, 4) AS boost_profit, round(fb * (d2 - 1) * 0.99, 4) AS after_slippage FROM h"""
)
def hedges(spark, d):
    """Three kinds of bonus, each hedged on the other side, and a guarantee net of slippage."""
    d1, d2, s = prices.decimal_odds(F.col("price")), prices.decimal_odds(F.col("other")), F.col("stake") * 1.0137931
    b = _bets(spark, d).withColumns({"f": prices.hedge_free_bet(s, d1, d2), "r": prices.hedge_risk_free(s, d1, d2), "b": prices.hedge_boost(s, d1, F.lit(0.3), d2)})
    return b.select("k", *[F.round(c + "." + part, 4).alias(name + part) for c, name in (("f", "free_"), ("r", "risk_"), ("b", "boost_")) for part in ("hedge", "profit")], F.round(prices.after_slippage(F.col("f.profit"), 0.01), 4).alias("after_slippage"))


@query(
    f"""WITH {BETS}, x AS (SELECT c, k, (d1 - 1) / d2 * (d2 - 1) AS conversion FROM (SELECT *, {DECIMAL.format("price")} AS d1, {DECIMAL.format("other")} AS d2 FROM bets)), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(conversion, 9) DESC, k) AS n FROM x)
SELECT c, k, round(conversion, 6) AS conversion FROM r WHERE n = 1"""
)
def best_conversion(spark, d):
    """The bonus price that turns most of a free bet into cash, of equal ones the first."""
    part = prices.hedge_free_bet(F.lit(1.0), prices.decimal_odds(F.col("price")), prices.decimal_odds(F.col("other")))["profit"]
    x = _bets(spark, d).withColumn("v", F.round(part, 9)).groupBy("c").agg(F.max(F.struct("v", (-F.col("k")).alias("m"))).alias("x"))
    return x.select("c", (-F.col("x.m")).alias("k"), r6(F.col("x.v"), "conversion"))


@query(
    f"""WITH {BETS}, {RATES}, t AS (SELECT k, h + a + CASE WHEN h = a THEN 1 ELSE 0 END AS t, p FROM cells), g AS (SELECT s_suppkey AS k, 4.5 + s_suppkey % 2 AS low, 6.5 + s_suppkey % 3 / 2.0 AS high, 1.86 + (s_suppkey % 5) / 20.0::DOUBLE AS a, 1.91 + (s_suppkey % 4) / 20.0::DOUBLE AS b FROM supplier)
SELECT k, round(sum(p * ((CASE WHEN t > low THEN a - 1 WHEN t = low THEN 0 ELSE -1 END) + (CASE WHEN t < high THEN b - 1 WHEN t = high THEN 0 ELSE -1 END))), 6) AS value, round(max(-(least(a, b) - 2) / (a + b - 2 - (least(a, b) - 2))), 6) AS breakeven FROM t JOIN g USING (k) GROUP BY k"""
)
def middle_values(spark, d):
    """What a middle is worth by the distribution of totals, and the chance of the middle at which it breaks even without one."""
    k = F.col("k")
    g = _rates(spark, d).withColumns({"low": 4.5 + F.pmod(k, F.lit(2)), "high": 6.5 + F.pmod(k, F.lit(3)) / 2, "a": 1.86 + F.pmod(k, F.lit(5)) / 20, "b": 1.91 + F.pmod(k, F.lit(4)) / 20})
    total = pmf.total_of(pmf.joint(pmf.poisson(F.col("lh")), pmf.poisson(F.col("la")), MARGINS))
    return g.select("k", r6(pmf.middle_value(total, F.col("low"), F.col("high"), F.col("a"), F.col("b")), "value"), r6(prices.middle_breakeven(F.col("a"), F.col("b")), "breakeven"))
