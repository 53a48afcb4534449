"""One query for each operator on the driver's tables, and the same in SQL.

Orders stand for games, customers for sides, lineitems summed by order for the statistics of a side in a game,
events for quotes: user for item, event type for venue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretime.functions import calendar as cal
from foretime.functions import pmf, prices
from foretime.functions.guards import ratio
from foretime.operators import joins, keyed, ledger, markets, pit, ranking, reshape, sequential, stats
from foretime.plans import features
from foretime.sources.tables import driver_table
from foretime.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores: the rows of a small file, each of which costs much work, would all be one task's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def games(spark: SparkSession, d: str) -> DataFrame:
    """custkey, orderkey, day, season and sums by order; prices are rounded to whole numbers, so sums are exact in any order."""
    li = driver_table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(F.round("l_extendedprice")).alias("rev"),
        F.count(F.lit(1)).alias("lines"),
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returned"),
    )
    o = driver_table(spark, d, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")
    )
    return o.join(li, o["orderkey"] == li["l_orderkey"]).drop("l_orderkey")


GAMES = """
games AS (
  SELECT o_custkey AS custkey, o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS season,
         o_orderpriority AS priority, o_totalprice AS price, qty, rev, lines, returned
  FROM orders JOIN (
    SELECT l_orderkey, sum(l_quantity) AS qty, sum(round(l_extendedprice)) AS rev, count(*) AS lines,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""


# --- windows ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {GAMES}
SELECT orderkey, CAST(count(*) OVER w5 AS INT) AS rows_5, CAST(count(*) OVER w20 AS INT) AS rows_20,
  round(CASE WHEN sum(lines) OVER w5 > 0 THEN sum(qty) OVER w5 / sum(lines) OVER w5 END, 6) AS qty_per_line_5,
  round(CASE WHEN sum(lines) OVER w20 > 0 THEN sum(qty) OVER w20 / sum(lines) OVER w20 END, 6) AS qty_per_line_20,
  round(CASE WHEN sum(lines) OVER w5 > 0 THEN 1.0 * sum(returned) OVER w5 / sum(lines) OVER w5 END, 6) AS return_share_5,
  round(CASE WHEN sum(lines) OVER w20 > 0 THEN 1.0 * sum(returned) OVER w20 / sum(lines) OVER w20 END, 6) AS return_share_20
FROM games WINDOW w5 AS (PARTITION BY custkey ORDER BY day, orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w20 AS (PARTITION BY custkey ORDER BY day, orderkey ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""
)
def prior_rows_ratio(spark, d):
    out = pit.prior_ratios(games(spark, d), ["custkey"], ["day", "orderkey"], {"qty_per_line": ("qty", "lines", 1.0), "return_share": ("returned", "lines", 1.0)}, [5, 20])
    return out.select("orderkey", "rows_5", "rows_20", *[r6(c, c) for c in ("qty_per_line_5", "qty_per_line_20", "return_share_5", "return_share_20")])


@query(
    f"""WITH {GAMES}
SELECT orderkey, CASE WHEN count(qty) OVER w >= 3 THEN round(avg(qty) OVER w, 6) END AS qty_mean_10,
  CASE WHEN count(qty) OVER w >= 3 THEN max(qty) OVER w END AS qty_max_10,
  CASE WHEN count(qty) OVER w >= 3 THEN round(stddev_samp(qty) OVER w, 6) END AS qty_std_10
FROM games WINDOW w AS (PARTITION BY custkey ORDER BY day, orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""
)
def prior_rows_min_periods(spark, d):
    out = games(spark, d)
    for how in ("mean", "max", "std"):
        out = pit.prior_rows(out, ["custkey"], ["day", "orderkey"], ["qty"], 10, how, least=3)
    return out.select("orderkey", r6("qty_mean_10", "qty_mean_10"), "qty_max_10", r6("qty_std_10", "qty_std_10"))


@query(
    f"""WITH {GAMES}, r AS (
SELECT custkey, season, orderkey, day, CASE WHEN sum(lines) OVER w5 > 0 THEN sum(qty) OVER w5 / sum(lines) OVER w5 END AS a,
  CASE WHEN sum(lines) OVER w10 > 0 THEN sum(qty) OVER w10 / sum(lines) OVER w10 END AS b
FROM games WINDOW w5 AS (PARTITION BY custkey, season ORDER BY day, orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY custkey, season ORDER BY day, orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT orderkey, round(a, 6) AS qty_rate_5, round(b, 6) AS qty_rate_10 FROM r"""
)
def window_pivot(spark, d):
    """Long by window, then wide again: the shape in which windows are stored."""
    wide = pit.prior_ratios(games(spark, d), ["custkey", "season"], ["day", "orderkey"], {"qty_rate": ("qty", "lines", 1.0)}, [5, 10])
    rows = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"qty_rate_{w}").alias("qty_rate")) for w in (5, 10)])
    long = wide.select("orderkey", F.inline(rows))
    return reshape.widen(long, ["orderkey"], "w", [5, 10], ["qty_rate"]).select("orderkey", r6("qty_rate_5", "qty_rate_5"), r6("qty_rate_10", "qty_rate_10"))


@query(
    f"""WITH {GAMES}, league AS (SELECT season + 1 AS season, sum(qty) / sum(lines) AS prior FROM games GROUP BY season),
r AS (SELECT orderkey, season, count(*) OVER w AS n, sum(qty) OVER w / sum(lines) OVER w AS raw FROM games
WINDOW w AS (PARTITION BY custkey ORDER BY day, orderkey ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT orderkey, round(CASE WHEN n > 0 AND raw IS NOT NULL THEN n / (n + 6.0) * raw + (1 - n / (n + 6.0)) * coalesce(prior, 25.0) ELSE coalesce(prior, 25.0) END, 6) AS shrunk
FROM r LEFT JOIN league USING (season)"""
)
def credibility_shrink(spark, d):
    g = games(spark, d)
    league = g.groupBy("season").agg(ratio(F.sum("qty"), F.sum("lines")).alias("prior")).withColumn("season", F.col("season") + 1)
    out = pit.prior_ratios(g, ["custkey"], ["day", "orderkey"], {"raw": ("qty", "lines", 1.0)}, [20]).join(league, "season", "left")
    return out.select("orderkey", r6(pit.shrunk(F.col("raw_20"), F.col("rows_20"), 6.0, F.coalesce("prior", F.lit(25.0))), "shrunk"))


@query(
    f"""WITH {GAMES}, by_c AS (SELECT custkey, count(qty) AS m, avg(qty) AS mean, var_samp(qty) AS v FROM games GROUP BY custkey HAVING count(qty) >= 5),
t AS (SELECT count(*) AS i, CAST(sum(m) AS DOUBLE) AS n, CAST(sum(m * m) AS DOUBLE) AS mm, sum(m * mean) AS s, sum(m * mean * mean) AS q, sum((m - 1) * v) AS w FROM by_c),
u AS (SELECT w / (n - i) AS msw, (q - s * s / n) / (i - 1) AS msb, (n - mm / n) / (i - 1) AS m0 FROM t)
SELECT round(CASE WHEN msb > msw THEN msw / ((msb - msw) / m0) ELSE 66.0 END, 4) AS k FROM u"""
)
def variance_components(spark, d):
    return stats.between_within_k(games(spark, d), "custkey", "qty").select(F.round("k", 4).alias("k"))


@query(
    f"""WITH {GAMES}
SELECT orderkey, coalesce(sum(qty) OVER w, 0) AS qty_365d FROM games
WINDOW w AS (PARTITION BY custkey ORDER BY day RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"""
)
def trailing_days_excluding_own(spark, d):
    return pit.trailing_days(games(spark, d), ["custkey"], "day", ["qty"], 365).select("orderkey", "qty_365d")


@query(
    f"""WITH {GAMES}
SELECT orderkey, count(*) OVER w AS n_before, coalesce(sum(qty) OVER w, 0) AS qty_sum_before FROM games
WINDOW w AS (PARTITION BY priority, season ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"""
)
def expanding_before_date(spark, d):
    return pit.expanding_before(games(spark, d), ["priority", "season"], "day", ["qty"]).select("orderkey", "n_before", "qty_sum_before")


@query(
    f"""WITH {GAMES}
SELECT g.orderkey, round(coalesce(sum(p.qty * pow(0.5, (g.day - p.day) / 365.0)), 0), 4) AS qty_decayed
FROM games g LEFT JOIN games p ON p.custkey = g.custkey AND p.day < g.day GROUP BY g.orderkey"""
)
def decayed_sum(spark, d):
    return pit.decayed_before(games(spark, d), ["custkey"], "day", ["qty"], 365.0).select("orderkey", F.round("qty_decayed", 4).alias("qty_decayed"))


@query(
    f"""WITH {GAMES}, s AS (SELECT orderkey,
  (coalesce(sum(qty) OVER slow, 0) + 300 * 100.0) / (count(qty) OVER slow + 300) AS slow_rate,
  coalesce(sum(qty) OVER fast, 0) AS fs, count(qty) OVER fast AS fn FROM games
WINDOW slow AS (PARTITION BY priority ORDER BY day RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING),
  fast AS (PARTITION BY priority ORDER BY day RANGE BETWEEN INTERVAL 120 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT orderkey, round((fs + 400 * slow_rate) / (fn + 400), 6) AS qty_env FROM s"""
)
def fast_slow_rate(spark, d):
    return pit.fast_and_slow(games(spark, d), ["priority"], "day", "qty", (120, 400.0), (365, 300.0), 100.0).select("orderkey", r6("qty_env", "qty_env"))


@query(
    f"""WITH {GAMES}, prev AS (SELECT season + 1 AS season, sum(qty) / sum(lines) AS prior FROM games GROUP BY season)
SELECT orderkey, round((coalesce(sum(qty) OVER w, 0) + 500 * coalesce(prior, 25.0)) / (coalesce(sum(lines) OVER w, 0) + 500), 6) AS env
FROM games LEFT JOIN prev USING (season)
WINDOW w AS (PARTITION BY priority, season ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"""
)
def season_to_date(spark, d):
    g = games(spark, d)
    prev = g.groupBy("season").agg((F.sum("qty") / F.sum("lines")).alias("prior")).withColumn("season", F.col("season") + 1)
    g = g.join(prev, "season", "left").fillna({"prior": 25.0})
    return pit.season_to_date_rate(g, ["priority"], "season", "day", "qty", "lines", "prior", 500.0).select("orderkey", r6("env", "env"))


@query(
    """WITH o AS (SELECT o_orderkey AS orderkey, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT orderkey, CAST(row_number() OVER w AS INT) AS game_num, CAST(day - lag(day) OVER w - 1 AS INT) AS rest, coalesce(day - lag(day) OVER w = 1, false) AS b2b
FROM o WINDOW w AS (PARTITION BY custkey ORDER BY day, orderkey)"""
)
def rest_and_game_number(spark, d):
    o = driver_table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("day"))
    w = Window.partitionBy("custkey").orderBy("day", "orderkey")
    rest = F.datediff("day", F.lag("day").over(w)) - 1
    return o.select("orderkey", F.row_number().over(w).alias("game_num"), rest.alias("rest"), F.coalesce(rest == 0, F.lit(False)).alias("b2b"))


@query(
    """WITH e AS (SELECT event_id, user_id, ts, event_type, value FROM events)
SELECT event_id, CASE WHEN lag(ts) OVER w IS NOT NULL THEN least(round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3), 600.0) END AS seconds_since, lag(event_type) OVER w AS prev_event_type, lag(value) OVER w AS prev_value
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def previous_event(spark, d):
    out = pit.previous_event(driver_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", ["event_type", "value"], 600.0)
    return out.select("event_id", F.round("seconds_since", 3).alias("seconds_since"), "prev_event_type", "prev_value")


@query(
    """WITH e AS (SELECT event_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)
SELECT a.event_id, (SELECT count(*) FROM e b WHERE b.event_type = a.event_type AND b.s >= a.s - 3600 AND (b.s < a.s OR b.s = a.s AND b.event_id < a.event_id)) AS recent FROM e a"""
)
def recent_count(spark, d):
    return pit.recent_count(driver_table(spark, d, "events"), ["event_type"], ["event_id"], "ts", 3600).select("event_id", "recent")


@query(
    f"""WITH {GAMES}, r AS (SELECT custkey, orderkey, day, sum(rev) OVER w AS running FROM games WINDOW w AS (PARTITION BY custkey ORDER BY day, orderkey ROWS UNBOUNDED PRECEDING))
SELECT custkey, orderkey, running, max(running - 100000.0 * n) OVER x - (running - 100000.0 * n) AS drawdown
FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY day, orderkey) AS n FROM r)
WINDOW x AS (PARTITION BY custkey ORDER BY day, orderkey ROWS UNBOUNDED PRECEDING)"""
)
def running_total_and_drawdown(spark, d):
    w = Window.partitionBy("custkey").orderBy("day", "orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = games(spark, d).withColumns({"running": F.sum("rev").over(w), "n": F.row_number().over(Window.partitionBy("custkey").orderBy("day", "orderkey"))})
    net = F.col("running") - 100000.0 * F.col("n")
    return out.withColumn("net", net).select("custkey", "orderkey", "running", (F.max("net").over(w) - F.col("net")).alias("drawdown"))


# --- as-of, nearest, top one -------------------------------------------------------------------------------------------


def _events(spark, d, kind):
    return driver_table(spark, d, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT p.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id FROM p
LEFT JOIN v ON v.user_id = p.user_id AND v.ts < p.ts AND epoch_us(p.ts) - epoch_us(v.ts) <= 86400000000 GROUP BY p.event_id"""
)
def asof_latest_bounded(spark, d):
    out = pit.asof_latest(_events(spark, d, "purchase"), _events(spark, d, "view"), ["user_id"], "ts", "ts", 86400, ["event_id"])
    return out.select("event_id", F.col("match.event_id").alias("view_id"))


@query(
    """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
j AS (SELECT c.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(c.ts) - epoch_us(v.ts)), v.ts, v.event_id) AS k
FROM c JOIN v ON v.user_id = c.user_id AND abs(epoch_us(c.ts) - epoch_us(v.ts)) <= 43200000000)
SELECT c.event_id, view_id FROM c LEFT JOIN j ON j.event_id = c.event_id AND k = 1"""
)
def nearest_in_time(spark, d):
    out = pit.nearest_within(_events(spark, d, "click"), _events(spark, d, "view"), ["user_id"], "ts", "ts", 43200, "event_id")
    return out.select("event_id", F.col("match.event_id").alias("view_id"))


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def top_one_per_group(spark, d):
    return pit.top_row(driver_table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, max(ts) AS ts, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def latest_by_key(spark, d):
    e = driver_table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return keyed.latest(e, ["user_id", "event_type"], "ts").select("user_id", "event_type", "ts", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sorted_top_k(spark, d):
    return driver_table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100)


# --- reshaping ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r
FROM lineitem GROUP BY l_orderkey"""
)
def pivot_wide(spark, d):
    li = driver_table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return li.select("l_orderkey", F.col("A").alias("qty_a"), F.col("N").alias("qty_n"), F.col("R").alias("qty_r"))


@query(
    """SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part"""
)
def unpivot_long(spark, d):
    return reshape.lengthen(driver_table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    """SELECT l_orderkey, l_linenumber, true AS is_home, l_suppkey AS side FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, false, l_partkey FROM lineitem"""
)
def union_of_sides(spark, d):
    return reshape.sides(driver_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"side": "l_suppkey"}, {"side": "l_partkey"})


@query(
    """WITH s AS (SELECT user_id, max_by(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS click, max_by(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id)
SELECT * FROM s WHERE click IS NOT NULL AND view IS NOT NULL"""
)
def two_sided_rows(spark, d):
    return reshape.two_sided(driver_table(spark, d, "events").withColumn("at", F.struct("ts", "event_id")), ["user_id"], "event_type", ["click", "view"], "value", "at")


# --- joins and sets ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, d):
    o = driver_table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return driver_table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return keyed.work_list(driver_table(spark, d, "customer"), driver_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_nationkey")


@query(
    """WITH f AS (SELECT o_custkey AS k, count(*) AS finished FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), u AS (SELECT o_custkey AS k, count(*) AS urgent FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT coalesce(f.k, u.k) AS k, finished, urgent FROM f FULL JOIN u ON f.k = u.k"""
)
def merge_reports(spark, d):
    o = driver_table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return keyed.merge_reports([o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.count(F.lit(1)).alias("finished")), o.filter("o_orderpriority LIKE '1%'").groupBy("k").agg(F.count(F.lit(1)).alias("urgent"))], ["k"])


@query(
    f"""WITH {GAMES} SELECT a.orderkey, count(*) AS opponents, sum(b.qty) AS opponent_qty FROM games a JOIN games b ON a.day = b.day AND a.priority = b.priority AND a.orderkey <> b.orderkey GROUP BY a.orderkey"""
)
def opponents(spark, d):
    """What the others of a group add up to: group sums minus one's own, instead of a self join that makes all pairs."""
    w = Window.partitionBy("day", "priority")
    out = games(spark, d).select("orderkey", (F.count(F.lit(1)).over(w) - 1).alias("opponents"), (F.sum("qty").over(w) - F.col("qty")).alias("opponent_qty"))
    return out.filter("opponents > 0")


@query(
    """WITH i AS (SELECT o_custkey AS k, epoch(o_orderdate) AS lo, epoch(o_orderdate) + 864000 AS hi FROM orders WHERE o_orderpriority LIKE '1%'),
p AS (SELECT o_orderkey, o_custkey AS k, epoch(o_orderdate) AS t FROM orders WHERE o_orderpriority LIKE '5%')
SELECT o_orderkey FROM p WHERE EXISTS (SELECT 1 FROM i WHERE i.k = p.k AND p.t >= lo AND p.t < hi)"""
)
def interval_containment(spark, d):
    o = driver_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_orderpriority")
    i = o.filter("o_orderpriority LIKE '1%'").select("k", F.col("t").alias("lo"), (F.col("t") + 864000).alias("hi"))
    return joins.contained(o.filter("o_orderpriority LIKE '5%'").select("o_orderkey", "k", "t"), i, ["k"], "t", "lo", "hi", 864000.0).select("o_orderkey")


@query(
    """WITH s AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), t AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, k FROM (SELECT k FROM s UNION SELECT k FROM t) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM s INTERSECT SELECT k FROM t) UNION ALL SELECT 'except', k FROM (SELECT k FROM t EXCEPT SELECT k FROM s)"""
)
def set_operations(spark, d):
    s = driver_table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    t = driver_table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda n, x: x.select(F.lit(n).alias("op"), "k")
    return named("union", s.union(t).distinct()).union(named("intersect", s.intersect(t))).union(named("except", t.subtract(s)))


@query(
    """WITH p AS (SELECT s_suppkey AS id, s_nationkey % 5 AS team, ['anna', 'bob', 'carl', 'dora', 'alex'][s_suppkey % 5 + 1] AS first, 'x' || s_suppkey % 37 AS sur FROM supplier),
m AS (SELECT id AS mention, team, CASE id % 3 WHEN 0 THEN first WHEN 1 THEN first[1] ELSE 'zed' END AS first, sur FROM p),
k00 AS (SELECT team, first, sur, min(id) AS id FROM p GROUP BY team, first, sur HAVING count(DISTINCT id) = 1), k01 AS (SELECT first, sur, min(id) AS id FROM p GROUP BY first, sur HAVING count(DISTINCT id) = 1),
k10 AS (SELECT team, first[1] AS i, sur, min(id) AS id FROM p GROUP BY team, first[1], sur HAVING count(DISTINCT id) = 1), k11 AS (SELECT first[1] AS i, sur, min(id) AS id FROM p GROUP BY first[1], sur HAVING count(DISTINCT id) = 1), k20 AS (SELECT team, sur, min(id) AS id FROM p GROUP BY team, sur HAVING count(DISTINCT id) = 1)
SELECT mention, coalesce(k00.id, k01.id, k10.id, k11.id, k20.id) AS person FROM m LEFT JOIN k00 ON k00.team = m.team AND k00.first = m.first AND k00.sur = m.sur LEFT JOIN k01 ON k01.first = m.first AND k01.sur = m.sur
  LEFT JOIN k10 ON k10.team = m.team AND k10.i = m.first[1] AND k10.sur = m.sur LEFT JOIN k11 ON k11.i = m.first[1] AND k11.sur = m.sur LEFT JOIN k20 ON k20.team = m.team AND k20.sur = m.sur"""
)
def name_resolution(spark, d):
    """Whole names, initials and strange first names of people of five teams, in other letters than those of the list."""
    c = F.col("s_suppkey")
    first = F.element_at(F.array(*map(F.lit, ("anna", "bob", "carl", "dora", "alex"))), (F.pmod(c, F.lit(5)) + 1).cast("int"))
    s = driver_table(spark, d, "supplier").select(c.alias("id"), F.pmod("s_nationkey", F.lit(5)).cast("string").alias("team"), first.alias("first"), F.concat(F.lit("x"), F.pmod(c, F.lit(37)).cast("string")).alias("sur"))
    kind = F.pmod("id", F.lit(3))
    given = F.when(kind == 0, F.translate(F.upper("first"), "AO", "ÁÖ")).when(kind == 1, F.concat(F.upper(F.substring("first", 1, 1)), F.lit("."))).otherwise("Zed")
    m = s.select(F.col("id").alias("mention"), "team", F.concat(F.lit(" "), given, F.lit("  "), F.upper("sur")).alias("name"))
    people = s.select("id", "team", F.concat("first", F.lit(" "), "sur").alias("name"))
    return joins.resolve_names(m, people, "name", "team", "id").select("mention", F.col("id").alias("person"))


@query(
    """WITH n AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS b FROM customer)
SELECT c_custkey, coalesce(b, c_acctbal) AS c_acctbal FROM n"""
)
def keyed_upsert(spark, d):
    old = driver_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey") % 3
    new = old.select("c_custkey", F.when(k == 0, F.lit(None)).when(k == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return keyed.upsert(old, new, ["c_custkey"], ["c_acctbal"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'c_acctbal' ELSE 'c_nationkey' END AS what FROM customer WHERE c_custkey % 3 IN (1, 2)")
def changed_rows(spark, d):
    old = driver_table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    k = F.col("c_custkey") % 3
    new = old.withColumns({"c_acctbal": F.when(k == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_nationkey": F.when(k == 2, F.lit(None)).otherwise(F.col("c_nationkey"))})
    return keyed.changed(old, new, ["c_custkey"], ["c_acctbal", "c_nationkey"]).select("c_custkey", F.array_join("changes", ",").alias("what"))


# --- aggregates ------------------------------------------------------------------------------------------------------------


@query(
    """SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 2"""
)
def filtered_aggregates(spark, d):
    out = driver_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return out.filter("parts >= 2")


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def rollup_with_pooled(spark, d):
    return driver_table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query(
    """SELECT CASE WHEN l_discount < 0.02 THEN '<0.02' WHEN l_discount < 0.05 THEN '[0.02,0.05)' WHEN l_discount < 0.08 THEN '[0.05,0.08)' ELSE '>=0.08' END AS bucket, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1
UNION ALL SELECT 'ALL', count(*), sum(l_quantity) FROM lineitem"""
)
def edge_buckets(spark, d):
    li = driver_table(spark, d, "lineitem").withColumn("bucket", stats.edge_bucket(F.col("l_discount"), [0.02, 0.05, 0.08]))
    return li.rollup("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")).fillna({"bucket": "ALL"})


@query(
    """SELECT o_orderpriority, round(median(o_totalprice), 1) AS mid, round(quantile_cont(o_totalprice, 0.05), 1) AS p5, round(quantile_cont(o_totalprice, 0.95), 1) AS p95 FROM orders GROUP BY o_orderpriority"""
)
def percentiles(spark, d):
    p = lambda q: F.round(F.percentile("o_totalprice", F.lit(q)), 1)
    return driver_table(spark, d, "orders").groupBy("o_orderpriority").agg(p(0.5).alias("mid"), p(0.05).alias("p5"), p(0.95).alias("p95"))


@query(
    f"""WITH {GAMES} SELECT orderkey, round(1.0 * lines / sum(lines) OVER w, 6) AS share,
round(CASE WHEN count(qty) OVER w > 1 THEN (rank() OVER (PARTITION BY day ORDER BY qty DESC) + (count(*) OVER (PARTITION BY day, qty) - 1) / 2.0 - 1) / (count(qty) OVER w - 1) ELSE 0.0 END, 6) AS rank_share
FROM games WINDOW w AS (PARTITION BY day)"""
)
def group_share_and_average_rank(spark, d):
    return games(spark, d).select("orderkey", r6(ranking.share_of_group(["day"], "lines"), "share"), r6(ranking.rank_share(["day"], "qty"), "rank_share"))


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS k FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, count(*) AS n FROM r WHERE k <= 10 GROUP BY o_custkey"""
)
def recent_ranked_counts(spark, d):
    o = driver_table(spark, d, "orders")
    k = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate").desc()))
    return o.withColumn("k", k).filter("k <= 10").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders")
def whole_row_numbers(spark, d):
    return ranking.whole_row_number(driver_table(spark, d, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_no")


@query(
    """WITH r AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) * 10 / (SELECT count(*) FROM lineitem)) AS INT) AS bin FROM lineitem)
SELECT bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM r GROUP BY bin"""
)
def equal_count_bins(spark, d):
    out = ranking.equal_count_bins(driver_table(spark, d, "lineitem"), ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 10)
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


# --- scores and tests ---------------------------------------------------------------------------------------------------


def _scored(spark, d):
    """y: returned; p: a chance made of the discount and the quantity; q: another one."""
    return driver_table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_returnflag",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.lit(0.05) + F.col("l_quantity") / 60.0).alias("p"),
        (F.lit(0.9) - F.col("l_quantity") / 60.0).alias("q"),
    )


SCORED = "s AS (SELECT l_orderkey, l_returnflag, CAST(l_returnflag = 'R' AS INT) AS y, 0.05 + l_quantity / 60.0 AS p, 0.9 - l_quantity / 60.0 AS q FROM lineitem)"


@query(f"WITH {SCORED} SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM s GROUP BY 1")
def reliability_bins(spark, d):
    return stats.reliability(_scored(spark, d), "y", "p").select("bin", "n", r6("mean_p", "mean_p"), r6("rate", "rate"))


@query(f"WITH {SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM s GROUP BY 1) SELECT round(sum(n * abs(m - r)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, d):
    return stats.calibration_error(_scored(spark, d), "y", "p").select(r6("ece", "ece"))


@query(
    f"""WITH {SCORED} SELECT l_returnflag, count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CAST((p >= 0.5) = (y = 1) AS INT)), 6) AS accuracy
FROM s GROUP BY ROLLUP (l_returnflag)"""
)
def scores_by_group(spark, d):
    return stats.scores(_scored(spark, d), "y", "p", ["l_returnflag"]).select("l_returnflag", "n", *[r6(c, c) for c in ("log_loss", "brier", "accuracy")])


@query(
    f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s)
SELECT round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r"""
)
def area_under_curve(spark, d):
    return stats.auc(_scored(spark, d), "y", "p").select(r6("auc", "auc"))


@query(f"WITH {SCORED}, x AS (SELECT (p - y) * (p - y) - (q - y) * (q - y) AS d FROM s) SELECT count(*) AS n, round(avg(d), 6) AS diff, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 3) AS z FROM x")
def paired_test(spark, d):
    s = _scored(spark, d).select(stats.brier(F.col("y"), F.col("p")).alias("a"), stats.brier(F.col("y"), F.col("q")).alias("b"))
    return stats.paired(s, "a", "b").select("n", r6("diff", "diff"), r6("se", "se"), F.round("z", 3).alias("z"))


@query(
    f"""WITH {SCORED}, m AS (SELECT avg(p - y) AS m, count(*) AS n FROM s), g AS (SELECT l_orderkey, sum(p - y - m.m) AS e FROM s, m GROUP BY l_orderkey)
SELECT any_value(m.n) AS n, count(*) AS clusters, round(any_value(m.m), 6) AS mean, round(sqrt(count(*) / (count(*) - 1.0) * sum(e * e)) / any_value(m.n), 6) AS se FROM g, m"""
)
def clustered_error(spark, d):
    return stats.clustered(_scored(spark, d).withColumn("d", F.col("p") - F.col("y")), "d", "l_orderkey").select("n", "clusters", r6("mean", "mean"), r6("se", "se"))


@query(
    """SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 4) AS se FROM lineitem"""
)
def regression_slope(spark, d):
    return stats.slope(driver_table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select("n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "se")])


@query(
    f"""WITH {GAMES}, f AS (SELECT season AS fold, min(day) - 7 AS until FROM games GROUP BY season HAVING season > (SELECT min(season) FROM games))
SELECT fold, CASE WHEN season = fold THEN 'validate' ELSE 'train' END AS part, count(*) AS n FROM games JOIN f ON season = fold OR season < fold AND day < until GROUP BY 1, 2"""
)
def walk_forward_folds(spark, d):
    from foretime.plans.models import assign_folds

    return assign_folds(games(spark, d).withColumn("date", F.col("day"))).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query()
def bootstrap_interval(spark, d):
    """Resampled; the test holds its interval against the clustered standard error."""
    g = games(spark, d).withColumn("lines", F.col("lines").cast("double"))
    return stats.bootstrap_ratio(g, "qty", "lines", "custkey", 500)


# --- prices ----------------------------------------------------------------------------------------------------------------


def _quotes(spark, d):
    """Quotes made of parts: item is the brand, venue the type's first word, American prices by arithmetic."""
    p = driver_table(spark, d, "part")
    home = F.lit(-250) + F.pmod(F.col("p_partkey") * 37, F.lit(130)).cast("int")
    away = F.lit(110) + F.pmod(F.col("p_partkey") * 53, F.lit(140)).cast("int")
    return p.select("p_partkey", F.col("p_brand").alias("item"), F.concat(F.lit("v"), F.pmod("p_partkey", F.lit(7))).alias("venue"), home.alias("home"), away.alias("away"), (F.pmod("p_size", F.lit(4)) / 2 + 5).alias("line"))


QUOTES = """q AS (SELECT p_partkey, p_brand AS item, 'v' || (p_partkey % 7) AS venue, CAST(-250 + (p_partkey * 37) % 130 AS INT) AS home, CAST(110 + (p_partkey * 53) % 140 AS INT) AS away, (p_size % 4) / 2.0 + 5 AS line FROM part),
f AS (SELECT *, -home / (100.0 - home) AS ih, 100.0 / (100 + away) AS ia, 1 - 100.0 / home AS dh, 1 + away / 100.0 AS da FROM q)"""


@query(f"WITH {QUOTES} SELECT p_partkey, round(ih, 6) AS implied_home, round(ih / (ih + ia), 6) AS fair_home, round(ih + ia - 1, 6) AS overround, round(dh, 6) AS decimal_home, round(greatest(((da - 1) * 0.4 - 0.6) / (da - 1), 0), 6) AS kelly_away FROM f")
def price_conversions(spark, d):
    q = markets.add_fair(_quotes(spark, d))
    return q.select(
        "p_partkey",
        r6(prices.implied(F.col("home")), "implied_home"),
        r6("fair_home", "fair_home"),
        r6("overround", "overround"),
        r6(prices.decimal_odds(F.col("home")), "decimal_home"),
        r6(prices.kelly(F.lit(0.4), prices.decimal_odds(F.col("away"))), "kelly_away"),
    )


@query(
    f"""WITH {QUOTES}, e AS (SELECT p_partkey, ih / (ih + ia) AS fair, dh, da, 0.3 + (p_partkey % 40) / 80.0 AS p FROM f),
k AS (SELECT *, ((dh - 1) * p - (1 - p)) / (dh - 1) AS kh, ((da - 1) * (1 - p) - p) / (da - 1) AS ka FROM e)
SELECT p_partkey, CASE WHEN p - fair >= 0.025 AND kh > 0 THEN 'HOME' WHEN fair - p >= 0.025 AND ka > 0 THEN 'AWAY' END AS side,
round(CASE WHEN p - fair >= 0.025 AND kh > 0 THEN least(0.25 * kh, 0.02) WHEN fair - p >= 0.025 AND ka > 0 THEN least(0.25 * ka, 0.02) END, 6) AS stake FROM k"""
)
def decisions(spark, d):
    q = markets.add_fair(_quotes(spark, d)).withColumn("p", F.lit(0.3) + F.pmod("p_partkey", F.lit(40)) / 80.0)
    q = q.withColumn("pick", prices.decide(F.col("p"), F.col("fair_home"), F.col("home"), F.col("away")))
    return q.select("p_partkey", F.col("pick.side").alias("side"), r6("pick.stake", "stake"))


@query(
    f"""WITH {QUOTES} SELECT item, round(median(ih / (ih + ia)), 6) AS fair_home, count(DISTINCT venue) AS venues, CAST(max(home) AS INT) AS best_home, min_by(venue, (-dh, venue)) AS best_home_venue, CAST(max(away) AS INT) AS best_away, min_by(venue, (-da, venue)) AS best_away_venue FROM f GROUP BY item"""
)
def consensus_and_best(spark, d):
    return markets.consensus(_quotes(spark, d), ["item"]).withColumn("fair_home", F.round("fair_home", 6))


@query(
    f"""WITH {QUOTES}, b AS (SELECT item, max(dh) AS a, max(da) AS b FROM f GROUP BY item) SELECT item, round(1 / (1 / a + 1 / b) - 1, 6) AS profit FROM b WHERE 1 / (1 / a + 1 / b) - 1 >= 0.001"""
)
def arbitrage(spark, d):
    return markets.arbitrages(_quotes(spark, d), ["item"]).select("item", r6("profit", "profit"))


@query(
    f"""WITH {QUOTES}, o AS (SELECT item, line AS low, max(da) AS dec_over FROM f GROUP BY 1, 2), u AS (SELECT item, line AS high, max(dh) AS dec_under FROM f GROUP BY 1, 2)
SELECT o.item, low, high, round(dec_over, 6) AS dec_over, round(dec_under, 6) AS dec_under FROM o JOIN u ON o.item = u.item AND low < high"""
)
def middles(spark, d):
    q = _quotes(spark, d).select("item", "venue", "line", F.col("away").alias("over"), F.col("home").alias("under"))
    return markets.middles(q, ["item"]).select("item", "low", "high", r6("dec_over", "dec_over"), r6("dec_under", "dec_under"))


@query(
    f"""WITH {QUOTES}, l AS (SELECT item, line, count(DISTINCT venue) AS venues, median(ia / (ia + ih)) AS fair_over FROM f GROUP BY 1, 2)
SELECT item, line, venues, round(fair_over, 6) AS fair_over FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY venues DESC, abs(fair_over - 0.5), line) AS k FROM l) WHERE k = 1"""
)
def main_line(spark, d):
    q = _quotes(spark, d).select("item", "venue", "line", F.col("away").alias("over"), F.col("home").alias("under"))
    return markets.main_line(q, ["item"]).select("item", "line", "venues", r6("fair_over", "fair_over"))


@query(
    f"""WITH {QUOTES}, v AS (SELECT item, venue, round(avg(ih / (ih + ia)), 9) AS x FROM f GROUP BY 1, 2)
SELECT a.item, a.venue, CAST(count(b.x) AS INT) AS others, round(median(b.x), 6) AS others_median FROM v a LEFT JOIN v b ON a.item = b.item AND a.venue <> b.venue GROUP BY 1, 2"""
)
def leave_one_out(spark, d):
    v = markets.add_fair(_quotes(spark, d)).groupBy("item", "venue").agg(F.round(F.avg("fair_home"), 9).alias("x"))
    return markets.leave_one_out(v, ["item"], "x").select("item", "venue", "others", r6("others_median", "others_median"))


# --- probability mass functions ---------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT p_partkey, 1.5 + (p_size % 20) / 10.0 AS r FROM part), k AS (SELECT p_partkey, r, i, exp(-r) * pow(r, i) / factorial(CAST(i AS INT)) AS p FROM l, range(0, 13) t(i)),
n AS (SELECT *, p / sum(p) OVER (PARTITION BY p_partkey) AS q FROM k)
SELECT p_partkey, round(sum(q * i), 6) AS mean, round(sum(q) FILTER (WHERE i > 2.5), 6) AS over_2_5, round(sum(q) FILTER (WHERE i = 2), 6) AS push_2 FROM n GROUP BY p_partkey"""
)
def poisson_over(spark, d):
    p = driver_table(spark, d, "part").select("p_partkey", pmf.poisson(F.lit(1.5) + F.pmod("p_size", F.lit(20)) / 10.0).alias("pmf"))
    return p.select("p_partkey", r6(pmf.mean(F.col("pmf")), "mean"), r6(pmf.over(F.col("pmf"), F.lit(2.5)), "over_2_5"), r6(pmf.push(F.col("pmf"), F.lit(2)), "push_2"))


@query(
    """WITH l AS (SELECT DISTINCT p_size, 1.5 + (p_size % 20) / 10.0 AS a, 3.4 - (p_size % 20) / 10.0 AS b FROM part),
h AS (SELECT p_size, i, exp(-a) * pow(a, i) / factorial(CAST(i AS INT)) AS p FROM l, range(0, 13) t(i)), w AS (SELECT p_size, i, exp(-b) * pow(b, i) / factorial(CAST(i AS INT)) AS p FROM l, range(0, 13) t(i)),
g AS (SELECT h.p_size, h.i AS hi, w.i AS wi, h.p * w.p * CASE least(abs(h.i - w.i), 2) WHEN 0 THEN 1.1 WHEN 1 THEN 0.8 ELSE 1.0 END AS p FROM h JOIN w USING (p_size)),
n AS (SELECT *, p / sum(p) OVER (PARTITION BY p_size) AS q FROM g)
SELECT p_size, round(sum(CASE WHEN hi > wi THEN q WHEN hi = wi THEN 0.5 * q ELSE 0 END), 6) AS home_win, round(sum(CASE WHEN hi + wi + CAST(hi = wi AS INT) > 5.5 THEN q ELSE 0 END), 6) AS over_5_5 FROM n GROUP BY p_size"""
)
def joint_scores(spark, d):
    p = driver_table(spark, d, "part").select("p_size").distinct()
    k = F.pmod("p_size", F.lit(20)) / 10.0
    g = p.select("p_size", pmf.joint(pmf.poisson(F.lit(1.5) + k), pmf.poisson(F.lit(3.4) - k), [1.1, 0.8, 1.0]).alias("grid"))
    return g.select("p_size", r6(pmf.home_win(F.col("grid"), F.lit(0.5)), "home_win"), r6(pmf.over(pmf.total_of(F.col("grid")), F.lit(5.5)), "over_5_5"))


@query("SELECT DISTINCT p_size, round(sqrt(p_size), 5) AS root FROM part")
def bisection_root(spark, d):
    p = driver_table(spark, d, "part").select("p_size").distinct()
    return p.select("p_size", F.round(pmf.bisect(lambda x: x * x, F.col("p_size").cast("double"), 0.0, 100.0), 5).alias("root"))


@query("SELECT p_partkey, 0.3 + (p_partkey % 40) / 100.0 AS over_2_5 FROM part")
def tilted_chance(spark, d):
    """A PMF bent to a given chance has that chance."""
    chance = F.lit(0.3) + F.pmod("p_partkey", F.lit(40)) / 100.0
    bent = pmf.tilted(pmf.poisson(F.lit(1.5) + F.pmod("p_size", F.lit(20)) / 10.0), F.lit(2.5), chance)
    parts = spread(driver_table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select("p_partkey", F.round(pmf.over(bent, F.lit(2.5)), 6).alias("over_2_5"))


# --- ledgers --------------------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT p_partkey, p_partkey % 6 AS h, p_size % 5 AS a, p_partkey % 3 AS m, p_size % 2 = 0 AS first, (p_partkey % 7) / 2.0 AS line, p_partkey % 11 <> 0 AS final, p_partkey % 13 = 0 AS void FROM part),
x AS (SELECT *, CASE WHEN m = 2 THEN CASE WHEN first THEN h + a - line ELSE line - h - a END ELSE CASE WHEN first THEN h - a ELSE a - h END + CASE WHEN m = 1 THEN line ELSE 0 END END AS ahead FROM l)
SELECT p_partkey, CASE WHEN void THEN 'VOID' WHEN NOT final THEN NULL WHEN ahead > 0 THEN 'WIN' WHEN ahead < 0 THEN 'LOSS' ELSE 'PUSH' END AS result FROM x"""
)
def leg_results(spark, d):
    k, first = F.pmod("p_partkey", F.lit(3)), F.pmod("p_size", F.lit(2)) == 0
    result = ledger.leg_result(
        F.when(k == 0, "ml").when(k == 1, "pl").otherwise("total"),
        F.when(k == 2, F.when(first, "over").otherwise("under")).otherwise(F.when(first, "home").otherwise("away")),
        F.pmod("p_partkey", F.lit(7)) / 2.0,
        F.pmod("p_partkey", F.lit(6)),
        F.pmod("p_size", F.lit(5)),
        F.pmod("p_partkey", F.lit(11)) != 0,
        F.pmod("p_partkey", F.lit(13)) == 0,
    )
    return driver_table(spark, d, "part").select("p_partkey", result.alias("result"))


@query(
    f"""WITH {GAMES}, b AS (SELECT priority, day, count(*) AS bets, CAST(sum(lines) AS BIGINT) AS staked, sum(qty - 100) AS pnl FROM games GROUP BY 1, 2)
SELECT priority, CAST(day AS VARCHAR) AS day, bets, staked, pnl, 1000 + sum(pnl) OVER (PARTITION BY priority ORDER BY day) AS balance FROM b"""
)
def daily_bankroll_log(spark, d):
    out = ledger.daily_log(games(spark, d).withColumn("gain", F.col("qty") - 100), "priority", "day", "lines", "gain")
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    """WITH t AS (SELECT o_custkey AS k, sum(round(o_totalprice)) FILTER (WHERE o_orderstatus = 'F') AS deposits, sum(round(o_totalprice)) FILTER (WHERE o_orderstatus = 'O') AS withdrawals FROM orders GROUP BY 1),
s AS (SELECT user_id AS k, sum(round(value)) AS pnl FROM events GROUP BY 1)
SELECT coalesce(t.k, s.k) AS k, coalesce(deposits, 0.0) AS deposits, coalesce(withdrawals, 0.0) AS withdrawals, coalesce(pnl, 0.0) AS pnl, coalesce(deposits, 0.0) - coalesce(withdrawals, 0.0) + coalesce(pnl, 0.0) AS balance FROM t FULL JOIN s ON t.k = s.k"""
)
def balance_table(spark, d):
    moves = driver_table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "deposit").when(F.col("o_orderstatus") == "O", "withdrawal").alias("kind"), F.round("o_totalprice").alias("amount"))
    slips = driver_table(spark, d, "events").select(F.col("user_id").alias("k"), F.round("value").alias("gain"))
    return ledger.balances(moves, slips, ["k"], "kind", "amount", "gain")


@query(
    f"""WITH {QUOTES}, e AS (SELECT ih / (ih + ia) AS m, 0.3 + (p_partkey % 40) / 80.0 AS p, p_partkey % 80 >= 25 AS y FROM f),
c AS (SELECT k / 40.0 AS s, sum(ln(CASE WHEN y THEN m + k / 40.0 * (p - m) ELSE 1 - m - k / 40.0 * (p - m) END)) AS ll FROM e, range(0, 41) t(k) GROUP BY 1),
b AS (SELECT arg_max(s, ll) AS s FROM c),
g AS (SELECT DISTINCT least(greatest(s + k / 800.0, 0), 1) AS s FROM b, range(-20, 21) t(k)),
x AS (SELECT s, sum(ln(CASE WHEN y THEN m + s * (p - m) ELSE 1 - m - s * (p - m) END)) AS ll FROM e, g GROUP BY s)
SELECT round(arg_max(s, ll), 6) AS trust FROM x"""
)
def trust_in_model(spark, d):
    q = markets.add_fair(_quotes(spark, d)).select("fair_home", (F.lit(0.3) + F.pmod("p_partkey", F.lit(40)) / 80.0).alias("p"), (F.pmod("p_partkey", F.lit(80)) >= 25).alias("y"))
    return spark.range(1).select(F.lit(round(ledger.trust(q, "p", "fair_home", "y"), 6)).alias("trust"))


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderpriority LIKE '1%' AS INT) AS urgent FROM orders)
SELECT o_orderkey, CASE WHEN count(*) OVER w >= 3 THEN round(avg(urgent) OVER w, 6) END AS urgent_share FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""
)
def recent_share(spark, d):
    o = driver_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").startswith("1").alias("urgent"))
    return o.select("o_orderkey", r6(features.recent_share(o, ["o_custkey"], ["day", "o_orderkey"], "urgent", 10, 3), "urgent_share"))


# --- arrays, JSON, strings, dates -------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS norm2, len(embedding) AS dims FROM embeddings")
def array_products(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return driver_table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(F.zip_with(v, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 4).alias("norm2"), F.size("embedding").cast("long").alias("dims"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_fields(spark, d):
    return driver_table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, CAST(CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS local_day FROM events")
def local_calendar_day(spark, d):
    return driver_table(spark, d, "events").select("event_id", cal.local_date(F.col("ts").cast("timestamp"), "America/Chicago").cast("string").alias("local_day"))


@query(
    """WITH n AS (SELECT n_nationkey AS k, -60 + n_nationkey * 5.0 AS lat, -170 + n_nationkey * 13.0 AS lon FROM nation)
SELECT a.k, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 1) AS km FROM n a JOIN n b ON b.k = a.k + 1"""
)
def travel_distance(spark, d):
    n = driver_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 5.0 - 60).alias("lat"), (F.col("n_nationkey") * 13.0 - 170).alias("lon"))
    b = n.select((F.col("k") - 1).cast("int").alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return n.join(b, "k").select("k", F.round(cal.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 1).alias("km"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def content_digest(spark, d):
    return driver_table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


# --- change detection ---------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type FROM e WHERE k = 1 OR event_type IS DISTINCT FROM before"""
)
def change_rows(spark, d):
    return changes.changes(driver_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query(
    """WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS snapshots, count(*) FILTER (WHERE k > 1 AND event_type IS DISTINCT FROM before) AS changes, max(ts) FILTER (WHERE k > 1 AND event_type IS DISTINCT FROM before) AS last_change FROM e GROUP BY user_id"""
)
def series_freshness(spark, d):
    return changes.freshness(driver_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", ["event_type"])


@query(
    """WITH m AS (SELECT quantile_disc(ts, 0.5) AS t FROM events), a AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS old FROM events, m WHERE ts < t GROUP BY 1), b AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS new FROM events, m WHERE ts >= t GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS event, old, new FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL OR old <> new"""
)
def snapshot_differences(spark, d):
    e = driver_table(spark, d, "events")
    mid = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(cast(ts as timestamp)))").alias("k")).first()["k"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    last = lambda x: x.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"))
    return changes.snapshot_diff(last(e.filter(at < int(mid))), last(e.filter(at >= int(mid))), ["user_id"], "s")


@query(
    """WITH e AS (SELECT event_type, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s, value FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY event_type ORDER BY s) > 3600 THEN 1 ELSE 0 END AS cut FROM e)
SELECT event_type, count(*) AS gaps FROM g WHERE cut = 1 GROUP BY event_type"""
)
def session_gaps(spark, d):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = driver_table(spark, d, "events").select("event_type", s.alias("s"))
    return pit.breaks(e, ["event_type"], "s", 3600).groupBy("event_type").agg(F.count(F.lit(1)).alias("gaps"))


# --- folds ----------------------------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE e AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)),
f(user_id, k, first, s) AS (SELECT user_id, k, s, s FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.s - f.first <= 604800 THEN f.first ELSE e.s END, e.s FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, first, count(*) AS members FROM f GROUP BY 1, 2"""
)
def anchored_clusters(spark, d):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return sequential.anchored_clusters(driver_table(spark, d, "events").select("user_id", s.alias("s")), ["user_id"], "s", 604800)


@query(
    f"""WITH RECURSIVE {GAMES}, o AS (SELECT 'l' || CAST(orderkey % 16 AS VARCHAR) AS league, orderkey AS g, day, season, CAST(custkey % 30 AS INT) + 1 AS ih, CAST((custkey + orderkey % 29 + 1) % 30 AS INT) + 1 AS ia, qty % 7 AS hs, rev % 6 AS aw FROM games),
n AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY day, g) AS i FROM o),
f(league, i, g, h, a, r, seen) AS (
  SELECT league, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1500.0::DOUBLE, 1500.0::DOUBLE, list_transform(range(30), lambda x: 1500.0::DOUBLE), list_transform(range(30), lambda x: CAST(0 AS INT)) FROM (SELECT DISTINCT league FROM n)
  UNION ALL
  SELECT league, i, g, h, a, list_transform(r, lambda x, j: CASE j WHEN ih THEN h + 20 * (won - e) WHEN ia THEN a - 20 * (won - e) ELSE x END), list_transform(seen, lambda x, j: CASE WHEN j = ih OR j = ia THEN season ELSE x END)
  FROM (SELECT *, 1 / (1 + pow(10, -((h + 50) - a) / 400)) AS e FROM (
    SELECT n.league, n.i, n.g, n.ih, n.ia, n.season, f.r, f.seen, CASE WHEN hs > aw THEN 1.0 WHEN hs < aw THEN 0.0 ELSE 0.5 END AS won,
      CASE WHEN f.seen[ih] IN (0, n.season) THEN f.r[ih] ELSE f.r[ih] + (1500 - f.r[ih]) / 3 END AS h, CASE WHEN f.seen[ia] IN (0, n.season) THEN f.r[ia] ELSE f.r[ia] + (1500 - f.r[ia]) / 3 END AS a
    FROM f JOIN n ON n.league = f.league AND n.i = f.i + 1)))
SELECT league, g AS game_id, round(h, 1) AS home_rating, round(a, 1) AS away_rating FROM f WHERE i > 0"""
)
def elo_ratings(spark, d):
    """Thirty sides in each of sixteen leagues play each other; leagues run side by side."""
    o = games(spark, d).select(F.concat(F.lit("l"), F.pmod("orderkey", F.lit(16)).cast("string")).alias("league"), F.col("orderkey").alias("game_id"), F.col("day").alias("date"), "season", F.concat(F.lit("t"), F.pmod("custkey", F.lit(30))).alias("home"), F.concat(F.lit("t"), F.pmod(F.col("custkey") + F.col("orderkey") % 29 + 1, F.lit(30))).alias("away"), F.pmod("qty", F.lit(7.0)).alias("home_score"), F.pmod("rev", F.lit(6.0)).alias("away_score"), F.lit(True).alias("final"))
    return sequential.elo(o)


@query(
    f"""WITH RECURSIVE {GAMES}, b AS (SELECT day, orderkey, CAST(left(priority, 1) AS INT) AS item, (orderkey % 50) / 1000.0::DOUBLE AS edge, 0.005 + (orderkey % 16) / 1000.0::DOUBLE AS stake FROM games),
n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY edge DESC, orderkey) AS i FROM b),
f(day, i, orderkey, kept, used, sums, ns) AS (
  SELECT day, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, 0.0::DOUBLE, [0.0::DOUBLE, 0, 0, 0, 0], [0, 0, 0, 0, 0] FROM (SELECT DISTINCT day FROM n)
  UNION ALL
  SELECT day, i, orderkey, fits, used + CASE WHEN fits THEN stake ELSE 0 END, list_transform(sums, lambda x, j: x + CASE WHEN fits AND j = item THEN stake ELSE 0 END), list_transform(ns, lambda x, j: x + CASE WHEN fits AND j = item THEN 1 ELSE 0 END)
  FROM (SELECT n.*, f.used, f.sums, f.ns, f.used + n.stake <= 0.1 + 1e-9 AND f.sums[item] + n.stake <= 0.04 + 1e-9 AND f.ns[item] < 3 AS fits FROM f JOIN n ON n.day = f.day AND n.i = f.i + 1))
SELECT orderkey, kept FROM f WHERE i > 0"""
)
def exposure_caps(spark, d):
    b = games(spark, d).select("day", "orderkey", F.col("priority").alias("item"), (F.pmod("orderkey", F.lit(50)) / 1000).alias("edge"), (0.005 + F.pmod("orderkey", F.lit(16)) / 1000).alias("stake"))
    return sequential.allocate(b, ["day"], "item", "edge", "stake", [-F.col("edge"), F.col("orderkey")]).select("orderkey", "kept")


@query(
    f"""WITH RECURSIVE {GAMES}, b AS (SELECT priority AS s, day, orderkey, 0.010137 + (orderkey % 10) / 1000.0::DOUBLE AS stake, CASE WHEN orderkey % 2 = 0 THEN 0.9513 ELSE -1.0 END AS gain FROM games),
n AS (SELECT *, row_number() OVER (PARTITION BY s, day ORDER BY orderkey) AS i FROM b),
f(s, day, i, used, took, stake, gain) AS (
  SELECT s, day, i, CASE WHEN stake <= 0.1 + 1e-9 THEN stake ELSE 0 END, stake <= 0.1 + 1e-9, stake, gain FROM n WHERE i = 1
  UNION ALL SELECT n.s, n.day, n.i, f.used + CASE WHEN f.used + n.stake <= 0.1 + 1e-9 THEN n.stake ELSE 0 END, f.used + n.stake <= 0.1 + 1e-9, n.stake, n.gain FROM f JOIN n ON n.s = f.s AND n.day = f.day AND n.i = f.i + 1),
t AS (SELECT s, day, count(*) FILTER (WHERE took) AS bets, coalesce(sum(stake) FILTER (WHERE took), 0) AS staked, coalesce(sum(stake * gain) FILTER (WHERE took), 0) AS ret FROM f GROUP BY 1, 2),
m AS (SELECT *, 1000 * product(1 + ret) OVER (PARTITION BY s ORDER BY day) AS balance FROM t)
SELECT s AS strategy, CAST(day AS VARCHAR) AS day, bets, round(staked * balance / (1 + ret), 4) AS staked, round(ret * balance / (1 + ret), 4) AS pnl, round(balance, 4) AS balance, round(1 - balance / greatest(1000, max(balance) OVER (PARTITION BY s ORDER BY day)), 5) AS drawdown FROM m"""
)
def bankroll_path(spark, d):
    b = games(spark, d).select(F.col("priority").alias("strategy"), "day", "orderkey", (0.010137 + F.pmod("orderkey", F.lit(10)) / 1000).alias("stake"), F.when(F.pmod("orderkey", F.lit(2)) == 0, 0.9513).otherwise(-1.0).alias("gain"))
    out = sequential.bankroll(b, "strategy", "day", ["orderkey"], "stake", "gain")
    return out.select("strategy", F.col("day").cast("string").alias("day"), "bets", *[F.round(c, 4).alias(c) for c in ("staked", "pnl", "balance")], F.round("drawdown", 5).alias("drawdown"))


@query(
    """WITH o AS (SELECT o_orderkey AS g, CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderdate AS DATE) AS day, o_custkey AS home, o_custkey + 1 AS away FROM orders),
s AS (SELECT g, season, day, home AS team, true AS h FROM o UNION ALL SELECT g, season, day, away, false FROM o),
n AS (SELECT g, h, CAST(row_number() OVER w AS INT) AS num, CAST(day - lag(day) OVER w - 1 AS INT) AS rest FROM s WINDOW w AS (PARTITION BY team, season ORDER BY day, g))
SELECT g AS game_id, max(num) FILTER (WHERE h) AS home_game_num, max(num) FILTER (WHERE NOT h) AS away_game_num, max(rest) FILTER (WHERE h) AS home_rest, max(rest) FILTER (WHERE NOT h) AS away_rest FROM n GROUP BY g"""
)
def schedule_features(spark, d):
    o = driver_table(spark, d, "orders").select(F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("home"), (F.col("o_custkey") + 1).alias("away"), F.lit(40.0).alias("lat"), F.lit(-75.0).alias("lon"), F.lit("America/New_York").alias("zone"))
    return features.schedule_features(o).select("game_id", "home_game_num", "away_game_num", "home_rest", "away_rest")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of sums over the orders before, by customer, wide by window."""
    return prior_rows_ratio(spark, d)
