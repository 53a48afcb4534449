"""Queries of settlement and margin weights on the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foretime.functions import pmf
from foretime.plans import checker, counts, margins, settling, totals
from foretime.plans.queries import query, r6
from foretime.sources.tables import driver_table

_P = "CASE WHEN {0} < 0 THEN -{0} / (100.0 - {0}) ELSE 100.0 / (100 + {0}) END"
PAPER = f"""
g AS (SELECT c_custkey AS game_id, TIMESTAMP '2024-01-15' + to_days(CAST(c_custkey % 15 AS INT)) AS start, CASE WHEN c_custkey % 17 = 0 THEN 'PPD' ELSE 'OK' END AS state, c_custkey % 5 AS hs, c_custkey % 7 AS "as", c_custkey % 6 > 0 AS over,
  TIMESTAMP '2024-01-15' + to_days(CAST(c_custkey % 15 AS INT)) - to_hours(CASE WHEN c_custkey % 9 = 0 THEN 5 ELSE 0 END) AS sched FROM customer WHERE c_custkey < 150),
b AS (SELECT o_orderkey AS rec_id, o_custkey % 150 AS game_id, CASE WHEN o_orderkey % 2 = 0 THEN 'HOME' ELSE 'AWAY' END AS side, ['click', 'view', 'error', 'purchase', 'kalshi'][o_orderkey % 5 + 1] AS book, CASE WHEN o_orderkey % 4 = 0 THEN -(110 + o_orderkey % 90) ELSE 105 + o_orderkey % 90 END AS price, 8.0 * (1 + o_orderkey % 7) AS stake,
  0.4::DOUBLE + (o_orderkey % 20) / 100.0::DOUBLE AS fair_prob, CASE WHEN o_orderkey % 11 > 0 THEN TIMESTAMP '2024-01-03' + to_days(CAST(o_orderkey % 10 AS INT)) END AS priced_at FROM orders WHERE o_orderkey % 13 > 0),
q AS (SELECT user_id AS game_id, event_type AS book, ts, -105 - CAST(event_id % 60 AS BIGINT) AS home_price, 101 + event_id % 50 AS away_price FROM events),
due AS (SELECT b.*, g.start, g.state, hs, "as", sched, over FROM b JOIN g USING (game_id) WHERE over OR state = 'PPD'),
last AS (SELECT d.rec_id, d.side, d.book AS own, q.book, arg_max(q.home_price, q.ts) AS hp, arg_max(q.away_price, q.ts) AS ap FROM due d JOIN q USING (game_id) WHERE (priced_at IS NULL OR q.ts > priced_at) AND q.ts < d.start GROUP BY d.rec_id, d.side, d.book, q.book),
closing AS (SELECT rec_id, max(CASE WHEN book = own THEN CASE WHEN side = 'HOME' THEN hp ELSE ap END END) AS cp, median({_P.format('hp')} / ({_P.format('hp')} + {_P.format('ap')})) AS home, any_value(side) AS side FROM last GROUP BY rec_id),
judged AS (SELECT due.*, cp, CASE WHEN closing.side = 'HOME' THEN home ELSE 1 - home END AS fair_close, CASE WHEN state = 'PPD' THEN true ELSE over AND abs(epoch(start) - epoch(sched)) > 10800 END AS void, (hs > "as") = (due.side = 'HOME') AS won, CASE WHEN book = 'kalshi' THEN 1 / ({_P.format('price')} + 0.07 * {_P.format('price')} * (1 - {_P.format('price')})) ELSE 1 / ({_P.format('price')}) END AS dec FROM due LEFT JOIN closing USING (rec_id))"""


@query(f"""WITH {PAPER}
SELECT rec_id, CASE WHEN void THEN 'VOID' WHEN won THEN 'WIN' ELSE 'LOSS' END AS result, CASE WHEN void THEN 0.0 WHEN won THEN round(stake * (dec - 1), 2) ELSE -stake END AS pnl, CASE WHEN NOT void THEN cp END AS closing_price,
  CASE WHEN NOT void THEN round(CASE WHEN cp IS NOT NULL THEN {_P.format('cp')} - {_P.format('price')} ELSE fair_close - fair_prob END, 4) END AS clv FROM judged""")
def settled_bets(spark, d):
    """Bets on games of customers, closed by quotes made of events."""
    k, day = F.col("o_orderkey"), lambda c: F.expr(f"make_interval(0, 0, 0, cast({c} as int), 0, 0, 0)")
    mod = lambda c, n: F.pmod(c, F.lit(n))
    c = F.col("c_custkey")
    start = F.lit("2024-01-15").cast("timestamp") + day("c_custkey % 15")
    games = driver_table(spark, d, "customer").filter("c_custkey < 150").select(
        c.alias("game_id"), start.alias("start"), F.lit(None).cast("date").alias("date"), F.when(mod(c, 17) == 0, "PPD").otherwise("OK").alias("schedule_state"), mod(c, 5).alias("home_score"), mod(c, 7).alias("away_score"), F.when(mod(c, 6) > 0, "FINAL").otherwise("FUT").alias("game_state")
    )
    books = F.array(*map(F.lit, ("click", "view", "error", "purchase", "kalshi")))
    bets = driver_table(spark, d, "orders").select(
        k.alias("rec_id"), mod(F.col("o_custkey"), 150).alias("game_id"), F.when(mod(k, 2) == 0, "HOME").otherwise("AWAY").alias("side"), F.element_at(books, (mod(k, 5) + 1).cast("int")).alias("book"), F.when(mod(k, 4) == 0, -(110 + mod(k, 90))).otherwise(105 + mod(k, 90)).alias("price"),
        (8.0 * (1 + mod(k, 7))).alias("stake"), (F.lit(0.4) + mod(k, 20) / 100).alias("fair_prob"), F.when(mod(k, 11) > 0, F.lit("2024-01-03").cast("timestamp") + day("o_orderkey % 10")).alias("priced_at"), F.lit("2024-01-02").cast("timestamp").alias("created_at"),
        F.when(mod(k, 13) == 0, "SETTLED").otherwise("ISSUED").alias("status"),
    )
    scheduled = games.select("game_id", (F.col("start") - F.when(mod(F.col("game_id"), 9) == 0, F.expr("INTERVAL 5 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))).alias("scheduled_start"))
    quotes = driver_table(spark, d, "events").select(F.col("user_id").alias("game_id"), F.col("event_type").alias("book"), F.col("ts").cast("timestamp").alias("captured_at"), (-105 - mod(F.col("event_id"), 60)).alias("home_price"), (101 + mod(F.col("event_id"), 50)).alias("away_price"))
    due = settling.due_bets(bets.join(scheduled, "game_id"), games)
    return settling.settled_bets(due, quotes).select("rec_id", "result", F.col("pnl").cast("double").alias("pnl"), "closing_price", "clv")


@query("""
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
legs AS (SELECT l_orderkey AS slip_id, n, ['ml', 'pl', 'total', 'prop_sog'][l_partkey % 4 + 1] AS market, CASE WHEN l_partkey % 4 < 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'HOME' ELSE 'AWAY' END ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'OVER' ELSE 'UNDER' END END AS side, CASE l_partkey % 4 WHEN 1 THEN l_linenumber % 5 / 2.0 - 1 ELSE l_linenumber % 9 / 2.0 + 1 END AS line,
  CASE WHEN l_suppkey % 8 > 0 THEN CASE WHEN l_partkey % 3 = 0 THEN -(100 + l_partkey % 80) ELSE 100 + l_partkey % 150 END END AS price, l_suppkey % 5 AS hs, l_suppkey % 7 AS ws, l_suppkey % 19 = 0 AS off, l_suppkey % 23 > 0 AS final, CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 6 END AS shots FROM li WHERE n <= 3),
told AS (SELECT *, CASE WHEN off THEN 'VOID' WHEN NOT final THEN NULL WHEN market = 'ml' THEN CASE WHEN hs = ws THEN NULL WHEN (hs > ws) = (side = 'HOME') THEN 'WIN' ELSE 'LOSS' END
  WHEN market = 'pl' THEN CASE sign(CASE WHEN side = 'HOME' THEN hs - ws ELSE ws - hs END + line) WHEN 0 THEN 'PUSH' WHEN 1 THEN 'WIN' ELSE 'LOSS' END
  WHEN market = 'total' THEN CASE WHEN hs + ws = line THEN 'PUSH' WHEN (hs + ws > line) = (side = 'OVER') THEN 'WIN' ELSE 'LOSS' END
  ELSE CASE WHEN shots IS NULL THEN 'VOID' WHEN shots = line THEN 'PUSH' WHEN (shots > line) = (side = 'OVER') THEN 'WIN' ELSE 'LOSS' END END AS result, CASE WHEN price < 0 THEN 1 - 100.0::DOUBLE / price ELSE 1 + price / 100.0::DOUBLE END AS dec FROM legs),
by_slip AS (SELECT slip_id, count(*) AS n, count(*) FILTER (WHERE result = 'LOSS') AS lost, count(*) FILTER (WHERE result IS NULL) AS waits, count(*) FILTER (WHERE result = 'WIN') AS won, count(*) FILTER (WHERE result = 'VOID') AS void, count(*) FILTER (WHERE result IN ('PUSH', 'VOID') AND price IS NULL) AS unknown, count(*) FILTER (WHERE price IS NULL) AS unpriced,
  coalesce(product(dec), 1) AS whole, coalesce(product(dec) FILTER (WHERE result = 'WIN'), 1) AS of_won, coalesce(product(dec) FILTER (WHERE result IN ('PUSH', 'VOID')), 1) AS of_dropped FROM told GROUP BY slip_id),
slips AS (SELECT o_orderkey AS slip_id, 100.0 * (1 + o_orderkey % 4) AS stake, o_orderkey % 5 = 0 AS bonus, 150 + o_orderkey % 700 AS asked, o_orderkey % 2 = 0 AS standard FROM orders),
j AS (SELECT slips.*, by_slip.* EXCLUDE slip_id, CASE WHEN standard AND unpriced = 0 THEN CASE WHEN whole >= 2 THEN round_even((whole - 1) * 100, 0) ELSE round_even(-100 / (whole - 1), 0) END ELSE asked END AS price FROM slips JOIN by_slip USING (slip_id)),
s AS (SELECT *, CASE WHEN lost > 0 THEN 'LOST' WHEN waits > 0 THEN 'OPEN' WHEN won = 0 THEN CASE WHEN void = n THEN 'VOID' ELSE 'PUSH' END WHEN unknown > 0 THEN 'OPEN' ELSE 'WON' END AS status,
  CASE WHEN n > 1 AND unpriced = 0 AND (CASE WHEN whole >= 2 THEN round_even((whole - 1) * 100, 0) ELSE round_even(-100 / (whole - 1), 0) END) = price THEN of_won ELSE (CASE WHEN price < 0 THEN 1 - 100.0::DOUBLE / price ELSE 1 + price / 100.0::DOUBLE END) / of_dropped END AS factor FROM j)
SELECT slip_id, status, CASE status WHEN 'LOST' THEN 0.0 WHEN 'OPEN' THEN NULL WHEN 'WON' THEN floor(round(stake * (factor - CASE WHEN bonus THEN 1 ELSE 0 END), 2)) ELSE CASE WHEN bonus THEN 0.0 ELSE stake END END AS payout FROM s""")
def settled_slips(spark, d):
    """Slips of up to three legs, every second one sold at the product of its legs; payouts to the whole coin below."""
    k, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    mod = lambda c, n: F.pmod(c, F.lit(n))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = driver_table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).filter("n <= 3")
    two = lambda a, b: F.when(mod(supp, 2) == 0, a).otherwise(b)
    legs = li.select(
        k.alias("slip_id"), F.col("n").alias("leg_no"), supp.alias("game_id"), F.lit(1).alias("player_id"), F.element_at(F.array(*map(F.lit, ("ml", "pl", "total", "prop_sog"))), (mod(part, 4) + 1).cast("int")).alias("market"), F.when(mod(part, 4) < 2, two("home", "away")).otherwise(two("over", "under")).alias("side"),
        F.when(mod(part, 4) == 1, mod(F.col("l_linenumber"), 5) / 2 - 1).otherwise(mod(F.col("l_linenumber"), 9) / 2 + 1).alias("line"), F.when(mod(supp, 8) > 0, F.when(mod(part, 3) == 0, -(100 + mod(part, 80))).otherwise(100 + mod(part, 150))).alias("price"), F.lit(None).cast("string").alias("result"),
    )
    s = driver_table(spark, d, "supplier").select(F.col("s_suppkey").alias("game_id"))
    g = F.col("game_id")
    games = s.select("game_id", mod(g, 5).alias("home_score"), mod(g, 7).alias("away_score"), F.when(mod(g, 19) == 0, "CNCL").otherwise("OK").alias("schedule_state"), F.when(mod(g, 23) > 0, "OFF").otherwise("LIVE").alias("game_state"))
    # a game's box score has a row of another player at least
    box = s.select("game_id", F.inline(F.array(F.struct(F.lit(1).alias("player_id"), F.when(mod(g, 6) > 0, mod(g, 6)).alias("shots")), F.struct(F.lit(2).alias("player_id"), F.lit(0).cast("long").alias("shots")))))
    decided = settling.decided_legs(legs, games, box)
    priced = legs.groupBy("slip_id").agg(F.count_if(F.col("price").isNull()).alias("unpriced"), F.collect_list("price").alias("p"))
    product = F.aggregate("p", F.lit(1.0), lambda a, x: a * settling.decimal_odds(x))
    o = F.col("o_orderkey")
    slips = driver_table(spark, d, "orders").join(priced, F.col("slip_id") == o).select(
        "slip_id", (100.0 * (1 + mod(o, 4))).alias("stake"), F.when((mod(o, 2) == 0) & (F.col("unpriced") == 0), settling.american_odds(product)).otherwise(150 + mod(o, 700)).alias("price"), (mod(o, 5) == 0).alias("is_bonus"), F.lit("OPEN").alias("status"), F.lit(None).cast("double").alias("payout")
    )
    return settling.slip_results(slips, decided).select("slip_id", "status", F.when(F.col("status") == "WON", F.floor("payout").cast("double")).otherwise(F.col("payout")).alias("payout"))


@query("""
WITH RECURSIVE g AS (SELECT 2.2 + (o_orderkey % 5) * 0.3::DOUBLE AS lh, 2.0 + (o_custkey % 4) * 0.35::DOUBLE AS la, least(abs(o_orderkey * 7 % 6 - o_custkey % 5), 4) AS b FROM orders),
ks AS (SELECT unnest(range(11)) AS k), fact AS (SELECT k, product(greatest(j.k2, 1)) AS f FROM ks JOIN (SELECT unnest(range(11)) AS k2) j ON j.k2 <= k GROUP BY k),
cells AS (SELECT lh, la, count(*) AS n FROM g GROUP BY lh, la),
ph AS (SELECT DISTINCT lh, k, pow(lh, k) / f AS p FROM cells, fact), pa AS (SELECT DISTINCT la, k, pow(la, k) / f AS p FROM cells, fact),
nh AS (SELECT lh, k, p / sum(p) OVER (PARTITION BY lh) AS p FROM ph), na AS (SELECT la, k, p / sum(p) OVER (PARTITION BY la) AS p FROM pa),
m AS (SELECT c.lh, c.la, c.n, least(abs(nh.k - na.k), 4) AS b, sum(nh.p * na.p) AS m FROM cells c JOIN nh ON nh.lh = c.lh JOIN na ON na.la = c.la GROUP BY c.lh, c.la, c.n, least(abs(nh.k - na.k), 4)),
wide AS (SELECT lh, la, any_value(n) AS n, list(m ORDER BY b) AS m FROM m GROUP BY lh, la),
obs AS (SELECT list(s ORDER BY b) AS o, any_value(t) AS t FROM (SELECT b, count(*) / (SELECT count(*) FROM g)::DOUBLE AS s, (SELECT count(*) FROM g)::DOUBLE AS t FROM g GROUP BY b)),
it AS (
  SELECT 0 AS i, 1.0::DOUBLE AS w0, 1.0::DOUBLE AS w1, 1.0::DOUBLE AS w2, 1.0::DOUBLE AS w3
  UNION ALL
  SELECT i + 1, w0 * o[1] / s0 / (o[5] / s4), w1 * o[2] / s1 / (o[5] / s4), w2 * o[3] / s2 / (o[5] / s4), w3 * o[4] / s3 / (o[5] / s4) FROM (
    SELECT i, w0, w1, w2, w3, any_value(o) AS o, sum(n * w0 * m[1] / (w0 * m[1] + w1 * m[2] + w2 * m[3] + w3 * m[4] + m[5])) / any_value(t) AS s0, sum(n * w1 * m[2] / (w0 * m[1] + w1 * m[2] + w2 * m[3] + w3 * m[4] + m[5])) / any_value(t) AS s1, sum(n * w2 * m[3] / (w0 * m[1] + w1 * m[2] + w2 * m[3] + w3 * m[4] + m[5])) / any_value(t) AS s2,
      sum(n * w3 * m[4] / (w0 * m[1] + w1 * m[2] + w2 * m[3] + w3 * m[4] + m[5])) / any_value(t) AS s3, sum(n * m[5] / (w0 * m[1] + w1 * m[2] + w2 * m[3] + w3 * m[4] + m[5])) / any_value(t) AS s4 FROM it, wide, obs WHERE i < 200 GROUP BY i, w0, w1, w2, w3)
), last AS (SELECT [w0, w1, w2, w3, 1.0::DOUBLE] AS w FROM it ORDER BY i DESC LIMIT 1)
SELECT CAST(k AS INT) AS bucket, round(o[k + 1], 6) AS observed, round(o[k + 1], 6) AS fitted, round(w[k + 1], 5) AS weight FROM obs, last, (SELECT unnest(range(5)) AS k)""")
def margin_weights(spark, d):
    """Weights fitted to the margins of orders; the SQL fits them by two hundred rounds of proportional fitting."""
    o, k = driver_table(spark, d, "orders"), F.col("o_orderkey")
    rate = lambda base, c, n, step: F.lit(base) + F.pmod(c, F.lit(n)) * step
    # as columns of their own, distributions are made once for each row and not in each sum over them
    g = o.select(pmf.poisson(rate(2.2, k, 5, 0.3), 10).alias("h"), pmf.poisson(rate(2.0, F.col("o_custkey"), 4, 0.35), 10).alias("a"), margins.margin_bucket(F.pmod(k * 7, F.lit(6)), F.pmod("o_custkey", F.lit(5))).alias("b"))
    g = g.select(margins.margin_masses(F.col("h"), F.col("a")).alias("m"), "b")
    out = margins.fitted_shares(g, "m", "b", margins.fit_margin_weights(g, "m", "b"))
    return out.select("bucket", r6("observed", "observed"), r6("fitted", "fitted"), F.round("weight", 5).alias("weight"))


PROPS = """props AS (SELECT l_orderkey % 400 AS game_id, l_returnflag || l_linestatus AS book, l_partkey % 5 AS shots, CASE WHEN l_suppkey % 3 = 0 THEN 2.0 ELSE l_suppkey % 3 + 0.5 END AS line, 0.3::DOUBLE + (l_partkey % 40) / 100.0::DOUBLE AS pm, 0.35::DOUBLE + (l_suppkey % 30) / 100.0::DOUBLE AS pk, 1.2::DOUBLE + (l_suppkey % 7) / 5.0::DOUBLE AS mu,
  CASE WHEN l_partkey % 3 = 0 THEN -(110 + l_partkey % 60) ELSE 100 + l_partkey % 90 END AS price, 120 + l_suppkey % 50 AS opened, l_linenumber % 2 = 0 AS early FROM lineitem)"""
_LL = "-(y * ln(greatest(least({0}, 1 - 1e-15), 1e-15)) + (1 - y) * ln(greatest(least(1 - {0}, 1 - 1e-15), 1e-15)))"


def _props(spark, d):
    mod = lambda c, n: F.pmod(c, F.lit(n))
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    shots = mod(p, 5).cast("int")
    return driver_table(spark, d, "lineitem").select(
        mod("l_orderkey", 400).alias("game_id"), F.concat("l_returnflag", "l_linestatus").alias("book"), shots.alias("shots"), F.when(mod(s, 3) == 0, 2.0).otherwise(mod(s, 3) + 0.5).alias("line"), (F.lit(0.3) + mod(p, 40) / 100).alias("p_model"), (F.lit(0.35) + mod(s, 30) / 100).alias("p_mkt"), (F.lit(1.2) + mod(s, 7) / 5).alias("mu"),
        F.when(mod(p, 3) == 0, -(110 + mod(p, 60))).otherwise(100 + mod(p, 90)).alias("over_price"), (120 + mod(s, 50)).alias("over_price_open"), F.when(mod("l_linenumber", 2) == 0, 1).otherwise(3).alias("updated"), F.lit(2).alias("start"),
    )


@query(f"""WITH {PROPS}, decided AS (SELECT *, CASE WHEN shots > line THEN 1.0 ELSE 0.0 END AS y FROM props WHERE shots <> line), scored AS (SELECT *, {_LL.format('pm')} AS lm, {_LL.format('pk')} AS lk FROM decided),
both_groups AS (SELECT * FROM scored UNION ALL SELECT * REPLACE ('POOLED' AS book) FROM scored), g AS (SELECT book, game_id, sum(lm - lk) AS s, count(*) AS k FROM both_groups GROUP BY book, game_id), m AS (SELECT book, sum(s) / sum(k) AS mean, sum(k) AS n, count(*) AS games FROM g GROUP BY book),
e AS (SELECT g.book, any_value(n)::BIGINT AS n, any_value(games) AS games, any_value(mean) AS mean, sqrt(any_value(games) / (any_value(games) - 1.0) * sum((s - k * mean) * (s - k * mean))) / any_value(n) AS se FROM g JOIN m USING (book) GROUP BY g.book)
SELECT book, n, games, round(avg(y), 6) AS over_rate, round(avg(lm), 6) AS loss_model, round(avg(lk), 6) AS loss_market, round(any_value(mean), 6) AS diff, round(any_value(se), 6) AS se, round(avg((pm - y) * (pm - y)), 6) AS brier_model, n >= 500 AND any_value(mean) + 1.96 * any_value(se) < 0 AS beats_market
FROM both_groups JOIN e USING (book) GROUP BY book, n, games""")
def props_against_prices(spark, d):
    """Model and market on the same props, errors clustered by game."""
    props = _props(spark, d)
    out = counts.against_prices(props.filter("shots <> line").withColumn("over_hit", (F.col("shots") > F.col("line")).cast("double")))
    return out.select("book", "n", "games", *[r6(c, c) for c in ("over_rate", "loss_model", "loss_market", "diff", "se", "brier_model")], "beats_market")


@query(f"""WITH {PROPS}, d AS (SELECT *, CASE WHEN early THEN price ELSE opened END AS used FROM props), o AS (SELECT *, CASE WHEN used < 0 THEN 1 - 100.0::DOUBLE / used ELSE 1 + used / 100.0::DOUBLE END AS dec FROM d), t AS (SELECT o.*, u AS threshold FROM o, (SELECT unnest([0.0::DOUBLE, 0.05, 0.1]) AS u))
SELECT threshold, count(*) AS props, count(*) FILTER (WHERE pm - 1 / dec >= threshold - 1e-12) AS bets, count(*) FILTER (WHERE pm - 1 / dec >= threshold - 1e-12 AND shots > line) AS hits, round(avg(CASE WHEN shots > line THEN dec - 1 ELSE -1 END) FILTER (WHERE pm - 1 / dec >= threshold - 1e-12), 6) AS roi FROM t GROUP BY threshold""")
def one_sided_overs(spark, d):
    return counts.over_only(_props(spark, d), [0.0, 0.05, 0.1]).select("threshold", "props", "bets", "hits", r6("roi", "roi"))


@query(f"""WITH {PROPS}, s AS (SELECT *, mu - shots * ln(mu) + ln(factorial(CAST(shots AS INT))::DOUBLE) AS po, mu * 1.1 - shots * ln(mu * 1.1) + ln(factorial(CAST(shots AS INT))::DOUBLE) AS hi FROM props), b AS (SELECT * FROM s UNION ALL SELECT * REPLACE ('POOLED' AS book) FROM s)
SELECT book, count(*) AS n, round(avg(shots), 6) AS mean_count, round(avg(po), 6) AS nll_po, round(avg(mu) - avg(shots), 6) AS bias_po, round(avg(hi), 6) AS nll_hi, round(avg(hi - po), 6) AS diff_hi, round(stddev_samp(hi - po) / sqrt(count(*)), 6) AS se_hi FROM b GROUP BY book""")
def count_scores(spark, d):
    """Two Poisson models of a count, by venue and pooled."""
    df = _props(spark, d).withColumn("mu_hi", F.col("mu") * 1.1)
    out = counts.score_counts(df, "book", {"po": ("mu", 0.0), "hi": ("mu_hi", 0.0)}, "shots", "po")
    return out.select("book", "n", *[r6(c, c) for c in ("mean_count", "nll_po", "bias_po", "nll_hi", "diff_hi", "se_hi")])


@query(f"""WITH {PROPS} SELECT book, round(avg(shots) / avg(mu), 6) AS level FROM props GROUP BY book""")
def level_of_venues(spark, d):
    return counts.level_constants(_props(spark, d)).select("book", r6("level", "level"))


CLOSES = """o AS (SELECT user_id % 60 AS game_id, event_type AS book, CASE WHEN event_id % 2 = 0 THEN 'over' ELSE 'under' END AS side, CASE WHEN event_id % 9 > 0 THEN -(101 + event_id % 30) END AS price, 5.5::DOUBLE + event_id % 3 * 0.5::DOUBLE AS point, date_trunc('day', ts) AS at_day FROM events),
known AS (SELECT * FROM o WHERE at_day < TIMESTAMP '2024-01-20' + to_days(CAST(game_id % 9 AS INT)) AND price IS NOT NULL),
snap AS (SELECT game_id, book, at_day, max(row(price, point)) FILTER (WHERE side = 'over') AS o, max(row(price, point)) FILTER (WHERE side = 'under') AS u FROM known GROUP BY game_id, book, at_day),
closing AS (SELECT game_id, book, o[2] AS line, o[1] AS over_price, u[1] AS under_price FROM snap WHERE o[2] = u[2] QUALIFY row_number() OVER (PARTITION BY game_id, book ORDER BY at_day DESC) = 1)"""


def _closing(spark, d):
    k, game = F.col("event_id"), F.pmod("user_id", F.lit(60))
    mod = lambda n: F.pmod(k, F.lit(n))
    start = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-20").cast("timestamp")) + F.pmod(game, F.lit(9)) * 86400)
    rows = driver_table(spark, d, "events").select(game.alias("game_id"), F.col("event_type").alias("book"), F.when(mod(2) == 0, "over").otherwise("under").alias("side"), F.when(mod(9) > 0, -(101 + mod(30))).alias("price"), (5.5 + mod(3) * 0.5).alias("point"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at"), start.alias("start"))
    return totals.closing_totals(rows)


@query(f"WITH {CLOSES} SELECT * FROM closing")
def closing_totals(spark, d):
    return _closing(spark, d)


@query(f"""WITH {CLOSES}, l AS (SELECT game_id, line, median(({_P.format('over_price')}) / (({_P.format('over_price')}) + ({_P.format('under_price')}))) AS f, count(*) AS n FROM closing GROUP BY game_id, line)
SELECT game_id, line, round(f, 6) AS fair_over, n AS n_books FROM l QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY n DESC, abs(f - 0.5), line) = 1""")
def market_overs(spark, d):
    return totals.market_overs(_closing(spark, d)).withColumn("fair_over", F.round("fair_over", 6))


@query("""WITH t AS (SELECT o_orderkey % 9 AS total, 3 + o_custkey % 8 / 2.0 AS line, 0.3::DOUBLE + (o_orderkey % 40) / 100.0::DOUBLE AS po, CASE WHEN o_custkey % 2 = 0 THEN 0.1::DOUBLE ELSE 0.0 END AS push, 0.4::DOUBLE + (o_custkey % 20) / 100.0::DOUBLE AS fo FROM orders),
s AS (SELECT CASE WHEN total > line THEN 1.0 ELSE 0.0 END AS y, po / (1 - push) AS m, fo AS k FROM t WHERE total <> line), l AS (SELECT -(y * ln(m) + (1 - y) * ln(1 - m)) AS a, -(y * ln(k) + (1 - y) * ln(1 - k)) AS b FROM s)
SELECT count(*) AS n, round(avg(a), 6) AS model_loss, round(avg(b), 6) AS market_loss, round(avg(a - b), 6) AS diff, round(stddev_samp(a - b) / sqrt(count(*)), 6) AS se, avg(a - b) + 1.96 * stddev_samp(a - b) / sqrt(count(*)) < 0 AS beats_market FROM l""")
def totals_against_prices(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mod = lambda x, n: F.pmod(x, F.lit(n))
    df = driver_table(spark, d, "orders").select(mod(k, 9).alias("total"), (3 + mod(c, 8) / 2).alias("line"), (0.3 + mod(k, 40) / 100).alias("p_over"), F.when(mod(c, 2) == 0, 0.1).otherwise(0.0).alias("p_push"), (0.4 + mod(c, 20) / 100).alias("fair_over"))
    return totals.totals_check(df).select("n", *[r6(x, x) for x in ("model_loss", "market_loss", "diff", "se")], "beats_market")


@query("""WITH r AS (SELECT user_id AS game_id, user_id % 4 AS season, CASE event_type WHEN 'click' THEN 'a' ELSE 'b' END AS side, arg_max(value, ts) AS v, max(ts) AS at_time FROM events WHERE event_type IN ('click', 'view') AND user_id % 7 + event_id % 40 > 0 GROUP BY 1, 2, 3),
q AS (SELECT *, round((v - floor(v)) * 0.9, 2)::DOUBLE - 0.02::DOUBLE AS bid, round((v - floor(v)) * 0.9, 2)::DOUBLE + 0.05::DOUBLE AS ask FROM r),
g AS (SELECT game_id, season, count(*) = 2 AND count(*) FILTER (WHERE bid > 0 AND ask < 1) = 2 AS ok, sum(ask) - 1 AS o FROM q GROUP BY game_id, season)
SELECT g.season, count(DISTINCT g.game_id) AS games, count(DISTINCT g.game_id) FILTER (WHERE ok) AS with_close, round(median(ask - bid) FILTER (WHERE ok), 4) AS median_spread, any_value(mo) AS median_overround, round(median((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(at_time)) / 6e7) FILTER (WHERE ok), 2) AS median_lead_min
FROM q JOIN g USING (game_id, season) JOIN (SELECT season, round(median(o) FILTER (WHERE ok), 4) AS mo FROM g GROUP BY season) m ON m.season = g.season GROUP BY g.season""")
def closes_by_season(spark, d):
    """Closes of an exchange, of which some lack a side or have no bid."""
    e = driver_table(spark, d, "events").filter("event_type IN ('click', 'view') AND user_id % 7 + event_id % 40 > 0").withColumn("t", F.col("ts").cast("timestamp"))
    r = e.groupBy(F.col("user_id").alias("game_id"), F.pmod("user_id", F.lit(4)).alias("season"), F.when(F.col("event_type") == "click", "a").otherwise("b").alias("side")).agg(F.max_by("value", "t").alias("v"), F.max("t").alias("at"))
    part = F.round((F.col("v") - F.floor("v")) * 0.9, 2)
    rows = r.select("game_id", "season", "side", (part - 0.02).alias("bid"), (part + 0.05).alias("ask"), "at", F.lit("2024-02-01").cast("timestamp").alias("start"))
    return totals.closes_by_season(rows).withColumn("median_lead_min", F.round("median_lead_min", 2))


@query(f"""WITH l AS (SELECT l_orderkey AS slip_id, l_suppkey AS game_id, CASE WHEN l_partkey % 4 = 0 THEN 'total' ELSE 'ml' END AS market, CASE WHEN l_partkey % 3 = 0 THEN -(110 + l_partkey % 40) ELSE 100 + l_partkey % 60 END AS price, CASE WHEN l_suppkey % 23 > 0 THEN 0.42::DOUBLE + (l_suppkey % 17) / 100.0::DOUBLE END AS p, CASE WHEN l_partkey % 4 = 0 THEN 0.05::DOUBLE ELSE 0.0 END AS push, l_linenumber FROM lineitem WHERE l_linenumber <= 2),
v AS (SELECT *, CASE WHEN price < 0 THEN 1 - 100.0::DOUBLE / price ELSE 1 + price / 100.0::DOUBLE END AS d, CASE WHEN push > 0 THEN p / (p + (1 - p - push)) ELSE p END - ({_P.format('price')}) AS edge FROM l),
j AS (SELECT *, CASE WHEN p IS NULL THEN 'NO-MODEL' WHEN p * (d - 1) - (1 - p - push) <= 0 THEN 'PASS' WHEN edge >= 0.025 AND market = 'ml' THEN 'BET' ELSE 'THIN' END AS verdict FROM v),
s AS (SELECT slip_id, count(*) AS legs, count(DISTINCT game_id) AS games, count(*) FILTER (WHERE p IS NULL) AS unknown, count(*) FILTER (WHERE verdict = 'BET') AS bets, product(d) AS fair, product(p) AS p_all, product(p * d + push) AS mult FROM j GROUP BY slip_id)
SELECT slip_id, legs, CASE WHEN unknown = 0 AND games = legs THEN round(mult - 1, 12) END AS ev, CASE WHEN unknown = 0 AND games = legs THEN round(CASE WHEN mult > 1 THEN least(greatest(((fair - 1) * p_all - (1 - p_all)) / (fair - 1), 0) * 0.25, 0.02) ELSE 0 END, 12) END AS stake,
  CASE WHEN unknown > 0 THEN 'NO-MODEL' WHEN games < legs THEN 'WITHHELD' WHEN mult <= 1 THEN 'PASS' WHEN bets = legs THEN 'BET' ELSE 'THIN' END AS verdict FROM s""")
def checked_slips(spark, d):
    """Slips of one or two legs against the model's chances."""
    mod = lambda x, n: F.pmod(F.col(x), F.lit(n))
    total = mod("l_partkey", 4) == 0
    legs = driver_table(spark, d, "lineitem").filter("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("slip_id"), F.col("l_suppkey").alias("game_id"), F.when(total, "total").otherwise("ml").alias("market"), F.when(mod("l_partkey", 3) == 0, -(110 + mod("l_partkey", 40))).otherwise(100 + mod("l_partkey", 60)).alias("price"),
        F.when(mod("l_suppkey", 23) > 0, F.lit(0.42) + mod("l_suppkey", 17) / 100).alias("p_win"), F.when(total, 0.05).otherwise(0.0).alias("p_push"), F.lit(None).cast("int").alias("offered"),
    )
    out = checker.judged_slips(checker.judged_legs(legs))
    return out.select("slip_id", "legs", F.round("ev", 12).alias("ev"), F.round("stake", 12).alias("stake"), "verdict")


@query(f"""WITH g AS (SELECT o_orderkey AS game_id, 0.35::DOUBLE + (o_orderkey % 31) / 100.0::DOUBLE AS p, 0.4::DOUBLE + (o_custkey % 21) / 100.0::DOUBLE AS fair, -115 + o_custkey % 10 AS hp, 100 + o_orderkey % 20 AS ap, 0.45::DOUBLE + (o_orderkey % 11) / 100.0::DOUBLE AS c, o_custkey % 2 = 0 AS won, o_orderkey % 3 = 0 AS ex FROM orders),
h AS (SELECT *, CASE WHEN hp < 0 THEN 1 - 100.0::DOUBLE / hp ELSE 1 + hp / 100.0::DOUBLE END AS hd, CASE WHEN ap < 0 THEN 1 - 100.0::DOUBLE / ap ELSE 1 + ap / 100.0::DOUBLE END AS ad FROM g),
s AS (SELECT *, CASE WHEN p - fair >= 0.025 AND ((hd - 1) * p - (1 - p)) > 0 THEN 'HOME' WHEN fair - p >= 0.025 AND ((ad - 1) * (1 - p) - p) > 0 THEN 'AWAY' END AS side FROM h),
b AS (SELECT *, CASE side WHEN 'HOME' THEN p - fair ELSE (1 - p) - (1 - fair) END AS edge, CASE side WHEN 'HOME' THEN hp ELSE ap END AS price, (side = 'HOME') = won AS hit, CASE side WHEN 'HOME' THEN c ELSE 1 - c END AS pc FROM s WHERE side IS NOT NULL),
f AS (SELECT *, CASE WHEN ex THEN 1 / (({_P.format('price')}) + 0.07 * ({_P.format('price')}) * (1 - ({_P.format('price')}))) ELSE 1 / ({_P.format('price')}) END AS dec FROM b),
k AS (SELECT *, CASE WHEN edge + 1e-12 < 0.025 THEN '<0.025' WHEN edge + 1e-12 < 0.04 THEN '[0.025,0.04)' WHEN edge + 1e-12 < 0.06 THEN '[0.04,0.06)' WHEN edge + 1e-12 < 0.09 THEN '[0.06,0.09)' ELSE '>=0.09' END AS bucket FROM f)
SELECT bucket, count(*) AS bets, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(edge), 6) AS avg_edge, round(avg(CASE WHEN hit THEN dec - 1 ELSE -1 END), 6) AS flat_roi, round(avg(pc * dec - 1), 6) AS close_ev, round(avg(CASE WHEN pc * dec - 1 > 0 THEN 1.0 ELSE 0 END), 6) AS beat_close FROM k GROUP BY ROLLUP (bucket)""")
def bet_table(spark, d):
    """What a strategy's bets brought, by edge and together."""
    mod = lambda x, n: F.pmod(F.col(x), F.lit(n))
    k, c = "o_orderkey", "o_custkey"
    venue = F.when(mod(k, 3) == 0, "kalshi").otherwise("x")
    games = driver_table(spark, d, "orders").select(
        F.col(k).alias("game_id"), F.to_date("o_orderdate").alias("date"), (F.lit(0.35) + mod(k, 31) / 100).alias("p"), (F.lit(0.4) + mod(c, 21) / 100).alias("fair"), (-115 + mod(c, 10)).alias("home"), (100 + mod(k, 20)).alias("away"), venue.alias("home_book"), venue.alias("away_book"), (F.lit(0.45) + mod(k, 11) / 100).alias("fair_close"), (mod(c, 2) == 0).alias("home_win")
    )
    out = checker.bet_summary(checker.made_bets(games, {"kalshi": 0.07}))
    return out.select("bucket", "bets", *[r6(x, x) for x in ("hit_rate", "avg_edge", "flat_roi", "close_ev", "beat_close")])
