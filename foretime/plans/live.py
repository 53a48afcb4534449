"""Queries of the slate path on the driver's tables, and the same in SQL from the whole history.

Customers make eight sides by their key; side t is at home to side t + 4 on days on which both have orders. The slate
of a season is its last day of games.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.plans import roles, slate, totals
from foretime.plans.features import TEAM_RATES, team_base
from foretime.plans.queries import query, r6
from foretime.plans.reports import _R
from foretime.sources.shared import written
from foretime.sources.tables import driver_table

W = [5, 20]

SIDE_SQL = """
lines AS (
  SELECT CAST(o_custkey % 8 AS INT) AS team, CAST(o_orderdate AS DATE) AS date, CAST(l_suppkey % 3 AS INT) AS unit, l_quantity, round(l_extendedprice) AS price, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), raw AS (
  SELECT team, date, CAST(year(date) AS INT) AS season, CAST(date - DATE '1990-01-01' AS BIGINT) * 10 + team % 4 AS game_id, sum(l_quantity) AS qty, count(*) AS n, sum(price) AS rev, sum(returned) AS returned FROM lines GROUP BY team, date
), base AS (
  SELECT team, season, date, game_id, qty AS gf, n AS ga, rev / 1e4 AS xgf, qty / 7.0 AS xga, qty + 5 + n AS cf, n + 7 + returned AS ca, qty + 5 AS ff, n + 7 AS fa, CASE WHEN game_id % 11 > 0 THEN 3600.0 END AS toi, qty + n AS sog_for, n + 20 AS sog_against,
    returned AS pp_goals, n AS pp_opps, returned AS ppga, n + 1 AS opp_pp_opps, rev / 1e5 AS pp_xgf, qty / 70.0 AS pk_xga, returned * 60.0 / 5 AS pp_toi, n * 30.0 / 4 AS sh_toi, qty AS fow, qty * 2 + 1 AS fo_total, 2.0 * n AS pim FROM raw
), games AS (
  SELECT h.game_id, h.season, h.date, h.team AS home, a.team AS away FROM raw h JOIN raw a ON h.date = a.date AND a.team = h.team + 4
), slates AS (
  SELECT games.* FROM games JOIN (SELECT season, max(date) AS date FROM games GROUP BY season) USING (season, date)
), units AS (
  SELECT team, date, CAST(year(date) AS INT) AS season, CAST(date - DATE '1990-01-01' AS BIGINT) * 10 + team % 4 AS game_id, team * 10 + unit AS goalie_id, sum(l_quantity) + 20 AS saves, sum(l_quantity) + count(*) + 20 AS shots, (sum(price) % 7 - 3) / 4.0 AS gsax, count(*) * 60 AS toi
  FROM lines GROUP BY team, date, unit
), starts AS (
  SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY team, date ORDER BY toi DESC, goalie_id) = 1
)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows by side and game, games, the slates, and rows by goalie and game (with is_starter)."""
    o, li = driver_table(spark, d, "orders"), driver_table(spark, d, "lineitem")
    lines = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.pmod("o_custkey", F.lit(8)).cast("int").alias("team"), F.to_date("o_orderdate").alias("date"), F.pmod("l_suppkey", F.lit(3)).cast("int").alias("unit"), F.col("l_quantity").alias("q"), F.round("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("int").alias("r")
    )
    season, game = F.year("date"), F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long") * 10 + F.pmod("team", F.lit(4))
    # a row for each side, day and unit: everything else is made of these, so the lines are read once
    by = written(lines.groupBy("team", "date", "unit").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.sum("r").alias("r")), "sides")
    raw = by.groupBy("team", "date").agg(F.sum("q").alias("qty"), F.sum("n").alias("n"), F.sum("price").alias("rev"), F.sum("r").alias("returned")).withColumns({"season": season, "game_id": game})
    c = F.col
    base = team_base(raw.select(
        "team", "season", "date", "game_id", c("qty").alias("gf"), c("n").alias("ga"), (c("rev") / 1e4).alias("xgf"), (c("qty") / 7).alias("xga"), (c("qty") + 5).alias("ff"), (c("n") + 7).alias("fa"), c("returned").alias("blocks_own"), c("n").alias("blocks_opp"), F.when(F.pmod("game_id", F.lit(11)) > 0, 3600.0).otherwise(0.0).alias("toi"),
        (c("qty") + c("n")).alias("sog_for"), (c("n") + 20).alias("sog_against"), c("returned").alias("pp_goals"), c("n").alias("pp_opps"), c("returned").alias("ppga"), (c("n") + 1).alias("opp_pp_opps"), (c("rev") / 1e5).alias("pp_xgf"), (c("qty") / 70).alias("pk_xga"), (c("returned") * 60.0).alias("pp_toi_raw"), (c("n") * 30.0).alias("sh_toi_raw"),
        c("qty").alias("fow"), (c("qty") * 2 + 1).alias("fo_total"), (2.0 * c("n")).alias("pim"),
    ))
    # a game is what both its sides have in common
    pair = raw.groupBy("game_id", "season", "date").agg(F.min("team").alias("home"), F.max("team").alias("away")).filter("home < away")
    last = pair.groupBy("season").agg(F.max("date").alias("last"))
    slates = pair.join(F.broadcast(last), "season").filter("date = last").drop("last")  # a row for each season
    units = by.withColumns({"season": season, "game_id": game})
    units = units.select("team", "date", "season", "game_id", (c("team") * 10 + c("unit")).alias("goalie_id"), (c("q") + 20).alias("saves"), (c("q") + c("n") + 20).alias("shots"), ((F.pmod("price", F.lit(7)) - 3) / 4).alias("gsax"), (c("n") * 60).alias("toi"), *[F.lit(0).alias(x) for x in ("hd_goals", "hd_att", "fen_goals", "fen_att", "xga")])
    first = units.groupBy("team", "date").agg(F.min_by("goalie_id", F.struct(-c("toi"), "goalie_id")).alias("first"))
    units = units.join(first, ["team", "date"]).withColumn("is_starter", c("goalie_id") == c("first")).drop("first")
    return base, pair, slates, units


def _vector_sql() -> str:
    names = sorted({n for r in _R.values() for n in re.findall(r"{(\w+)}", r)})
    frames = ", ".join(f"w{k} AS (PARTITION BY team, season ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in W)
    sums = ", ".join(f"CAST(sum({n}) OVER w{k} AS DOUBLE) AS {n}_{k}" for k in W for n in names) + ", " + ", ".join(f"count(*) OVER w{k} AS games_{k}" for k in W)
    rates = ", ".join(f"CASE WHEN isfinite({e}) THEN {e} END AS {name}_{k}" for k in W for name, r in _R.items() for e in ["(" + r.format(**{n: f"{n}_{k}" for n in names}) + ")"])
    gframes = ", ".join(f"w{k} AS (PARTITION BY goalie_id, season ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in W)
    gsums = ", ".join(f"count(*) OVER w{k} AS n_{k}, CAST(sum(saves) OVER w{k} AS DOUBLE) / sum(shots) OVER w{k} AS sv_{k}, greatest(least(3600.0 * CAST(sum(gsax) OVER w{k} AS DOUBLE) / sum(toi) OVER w{k}, 99), -99) AS gs_{k}" for k in W)
    shrunk = ", ".join(f"n_{k} / (n_{k} + 66.0) AS z_{k}, CASE WHEN n_{k} > 0 THEN n_{k} / (n_{k} + 66.0) * sv_{k} + (1 - n_{k} / (n_{k} + 66.0)) * coalesce(league_sv, 0.905) ELSE coalesce(league_sv, 0.905) END AS shrunk_sv_{k}, CASE WHEN n_{k} > 0 THEN n_{k} / (n_{k} + 66.0) * gs_{k} + (1 - n_{k} / (n_{k} + 66.0)) * coalesce(league_gsax, 0) ELSE coalesce(league_gsax, 0) END AS shrunk_gsax_{k}" for k in W)
    out = [f"round(coalesce(h.{n}_{k} - a.{n}_{k}, 0), 5) AS {n}_diff_w{k}" for k in W for n in TEAM_RATES] + [f"CAST({s}.games_{k} AS DOUBLE) AS gp_{p}_w{k}" for k in W for p, s in (("home", "h"), ("away", "a"))]
    out += [f"round(coalesce(hg.{n}_{k} - ag.{n}_{k}, 0), 5) AS goalie_{n}_diff_w{k}" for k in W for n in slate.GOALIE_RATES]
    return f"""WITH {SIDE_SQL}, sums AS (SELECT team, date, {sums} FROM base WINDOW {frames}), rates AS (SELECT team, date, {", ".join(f"games_{k}" for k in W)}, {rates} FROM sums),
priors AS (SELECT season + 1 AS season, CAST(sum(saves) AS DOUBLE) / sum(shots) AS league_sv, 3600.0 * CAST(sum(gsax) AS DOUBLE) / sum(toi) AS league_gsax FROM units GROUP BY season),
gsums AS (SELECT goalie_id, team, season, date, {gsums} FROM units WINDOW {gframes}), goalies AS (SELECT goalie_id, team, date, {shrunk} FROM gsums LEFT JOIN priors USING (season))
SELECT s.game_id, s.season, {", ".join(out)}, CAST(s.home % 2 AS DOUBLE) AS starter_fallback_home, CAST(s.away % 2 AS DOUBLE) AS starter_fallback_away, CAST(s.home - s.away AS DOUBLE) AS elo_diff,
  CAST(s.date - DATE '1990-01-01' AS DOUBLE) % 3 - 1 AS rest_diff, 0.0 AS b2b_home, 1.0 AS b2b_away, CASE WHEN s.game_id % 2 = 0 THEN round(lml / (lml + wml), 6) ELSE 0.5 END AS market_prob, CASE WHEN s.game_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS market_available
FROM (SELECT *, (110 + game_id % 40) / (210.0 + game_id % 40) AS lml, (120 + game_id % 30) / (220.0 + game_id % 30) AS wml FROM slates) s
JOIN rates h ON h.team = s.home AND h.date = s.date JOIN rates a ON a.team = s.away AND a.date = s.date
JOIN starts hs ON hs.team = s.home AND hs.date = s.date JOIN starts ast ON ast.team = s.away AND ast.date = s.date
JOIN goalies hg ON hg.goalie_id = hs.goalie_id AND hg.date = s.date JOIN goalies ag ON ag.goalie_id = ast.goalie_id AND ag.date = s.date"""


@query(_vector_sql())
def slate_vectors(spark, d):
    """The last day of each season as if it hadn't been played; the SQL takes the rows of all days, played."""
    base, _, slates, units = _sides(spark, d)
    k = F.col("game_id")
    line = lambda plus, n: -(F.lit(plus) + F.pmod(k, F.lit(n)))
    lines = slates.select("game_id", line(110, 40).alias("home_ml"), line(120, 30).alias("away_ml"), F.when(F.pmod(k, F.lit(2)) == 0, 6.0).otherwise(4.0).alias("over_under"))  # every second one is from during the game
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    games = slates.withColumns({
        "home_score": F.lit(None).cast("int"), "away_score": F.lit(None).cast("int"), "home_elo": F.col("home").cast("double"), "away_elo": F.col("away").cast("double"), "home_rest": F.pmod(day, F.lit(3)), "away_rest": F.lit(1), "home_b2b": F.lit(None).cast("boolean"), "away_b2b": F.lit(True),
        "home_travel_km": F.lit(None).cast("double"), "away_travel_km": F.lit(1.0), "home_tz_shift": F.lit(0.0), "away_tz_shift": F.lit(0.0), "home_game_num": F.lit(1), "away_game_num": F.lit(1), "stage": F.lit("MID"),
    })
    announced = units.filter("is_starter").select("team", "date", "goalie_id", (F.pmod("team", F.lit(2)) == 0).alias("confirmed"))
    # the slate's own rows are in the history too: the live path must not look at them
    out = slate.slate_vectors(games, base, units, units.filter("is_starter"), slate.league_priors(units, F.col("season") + 1), announced, slate.market_of_lines(lines), W)
    rounded = [c for c in out.columns if "_diff_w" in c]
    out = out.withColumns({c: F.round(c, 5) for c in rounded} | {"market_prob": F.round("market_prob", 6)})
    return out.select("game_id", "season", *rounded, *[f"gp_{p}_w{w}" for w in W for p in ("home", "away")], "starter_fallback_home", "starter_fallback_away", "elo_diff", "rest_diff", "b2b_home", "b2b_away", "market_prob", "market_available")


@query(f"""WITH {SIDE_SQL}, past AS (
  SELECT st.team, st.season, st.goalie_id, st.date, dense_rank() OVER (PARTITION BY st.team, st.season ORDER BY st.date DESC) AS k FROM starts st JOIN (SELECT DISTINCT season, date FROM slates) s ON s.season = st.season AND st.date < s.date
), counted AS (SELECT team, season, goalie_id, count(*) FILTER (WHERE k <= 10) AS n, max(date) AS last FROM past GROUP BY team, season, goalie_id
), picks AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY team, season ORDER BY n DESC, last DESC, goalie_id) = 1
), each_side AS (SELECT game_id, season, date, home AS team FROM slates UNION ALL SELECT game_id, season, date, away FROM slates)
SELECT b.game_id, b.season, b.team, CASE WHEN b.team % 3 = 0 THEN starts.goalie_id ELSE picks.goalie_id END AS goalie_id, CASE WHEN b.team IN (0, 6) THEN 0 ELSE 1 END AS fallback
FROM each_side b JOIN starts ON starts.team = b.team AND starts.date = b.date LEFT JOIN picks ON picks.team = b.team AND picks.season = b.season""")
def projected_starters(spark, d):
    """Two sides of three have no announced goalie."""
    _, _, slates, units = _sides(spark, d)
    starts = units.filter("is_starter")
    announced = starts.select("team", "date", F.when(F.pmod("team", F.lit(3)) == 0, F.col("goalie_id")).alias("goalie_id"), (F.pmod("team", F.lit(2)) == 0).alias("confirmed"))
    return slate.project_starters(starts, slates, announced).select("game_id", "season", "team", "goalie_id", "fallback")


@query(f"""WITH {SIDE_SQL}, t AS (SELECT team, season, date, goalie_id, row_number() OVER (PARTITION BY team ORDER BY date) AS k, row_number() OVER (PARTITION BY team, season ORDER BY date) AS ks, row_number() OVER (PARTITION BY team, season, goalie_id ORDER BY date) AS own FROM starts),
q AS (SELECT * FROM t),
share AS (SELECT q.team, q.date, avg(CASE WHEN s.goalie_id = q.goalie_id THEN 1.0 ELSE 0 END) AS s10 FROM q JOIN t s ON s.team = q.team AND s.k < q.k AND s.k >= q.k - 10 WHERE q.k > 3 GROUP BY q.team, q.date),
best AS (SELECT q.team, q.date, max(c.n) AS most FROM q JOIN (SELECT a.team, a.date, b.goalie_id, count(*) AS n FROM t a JOIN t b ON b.team = a.team AND b.season = a.season AND b.date < a.date GROUP BY a.team, a.date, b.goalie_id) c ON c.team = q.team AND c.date = q.date GROUP BY q.team, q.date),
whole AS (SELECT team, season + 1 AS season, goalie_id, count(*) AS n FROM t GROUP BY team, season, goalie_id), topped AS (SELECT team, season, max(n) AS n FROM whole GROUP BY team, season),
rest AS (SELECT q.team, q.date, max(u.date) AS last FROM q JOIN units u ON u.goalie_id = q.goalie_id AND u.date < q.date GROUP BY q.team, q.date),
days AS (SELECT date, sum(saves) AS s, sum(shots) AS a, count(*) AS n FROM units GROUP BY date),
lg AS (SELECT date, CASE WHEN sum(n) OVER w > 0 THEN CAST(sum(s) OVER w AS DOUBLE) / sum(a) OVER w ELSE 0.905::DOUBLE END AS p, CASE WHEN sum(n) OVER w > 0 THEN CAST(sum(a) OVER w AS DOUBLE) / sum(n) OVER w ELSE 28.0::DOUBLE END AS bar FROM days WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
nu AS (SELECT *, row_number() OVER (PARTITION BY goalie_id ORDER BY date) AS i FROM units), cum AS (SELECT goalie_id, date, i, CAST(sum(saves) OVER w AS DOUBLE) AS cs, CAST(sum(shots) OVER w AS DOUBLE) AS ca FROM nu WINDOW w AS (PARTITION BY goalie_id ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
pairs AS (SELECT q.team, q.date, q.goalie_id, arg_max(c.who, c.n * 100000 + c.last) AS alt FROM q LEFT JOIN (SELECT a.team, a.date, b.goalie_id AS who, count(*) AS n, max(b.k) AS last FROM t a JOIN t b ON b.team = a.team AND b.k < a.k AND b.k >= a.k - 20 AND b.goalie_id <> a.goalie_id GROUP BY a.team, a.date, b.goalie_id) c ON c.team = q.team AND c.date = q.date GROUP BY q.team, q.date, q.goalie_id),
asked AS (SELECT DISTINCT goalie_id AS g, date FROM q UNION SELECT alt, date FROM pairs WHERE alt IS NOT NULL),
lasts AS (SELECT a.g, a.date, max(c.i) AS i FROM asked a LEFT JOIN cum c ON c.goalie_id = a.g AND c.date < a.date GROUP BY a.g, a.date),
carry AS (SELECT l.g, l.date, CASE WHEN c.cs IS NULL THEN p ELSE (cs + 30 * bar * p) / (ca + 30 * bar) END AS sv FROM lasts l JOIN lg ON lg.date = l.date LEFT JOIN cum c ON c.goalie_id = l.g AND c.i = l.i)
SELECT q.team, epoch(q.date)::BIGINT AS at_s, round(s10, 6) AS role_start_share_10, round(CASE WHEN q.ks > 1 THEN (q.own - 1) / (q.ks - 1.0) END, 6) AS role_start_share_season, CASE WHEN q.ks > 1 THEN CASE WHEN q.own - 1 >= most THEN 1.0 ELSE 0.0 END WHEN topped.n IS NOT NULL THEN CASE WHEN coalesce(whole.n, 0) >= topped.n THEN 1.0 ELSE 0.0 END END AS role_is_primary,
  CASE WHEN last IS NOT NULL THEN CAST(least(q.date - last, 10) AS DOUBLE) END AS role_rest_days, CASE WHEN q.date - last = 1 THEN 1.0 ELSE 0.0 END AS role_started_yesterday, round(c.sv, 6) AS role_carry_sv, round(coalesce(c.sv - o.sv, 0), 6) AS role_starter_minus_alt
FROM q LEFT JOIN share USING (team, date) LEFT JOIN best USING (team, date) LEFT JOIN rest USING (team, date) LEFT JOIN topped ON topped.team = q.team AND topped.season = q.season LEFT JOIN whole ON whole.team = q.team AND whole.season = q.season AND whole.goalie_id = q.goalie_id
JOIN pairs ON pairs.team = q.team AND pairs.date = q.date JOIN carry c ON c.g = q.goalie_id AND c.date = q.date LEFT JOIN carry o ON o.g = pairs.alt AND o.date = q.date""")
def goalie_roles(spark, d):
    """The role of every starter before his game."""
    _, _, _, units = _sides(spark, d)
    asked = units.filter("is_starter").select("game_id", "team", "goalie_id", "date", "season")
    out = roles.role_features(units, asked, F.col("season") - 1)
    return out.select("team", F.unix_seconds(F.col("date").cast("timestamp")).alias("at_s"), *[r6(c, c) for c in roles.FEATURES])


def _attack_sql() -> str:
    names = [f"round({p}.{n}_{k}{' / (0.5 * s.env)' if n in totals.PER_HOUR else ''}, 5) AS {q}_{n}_w{k}" for k in W for p, q, ns in (("o", "off", totals.ATTACK), ("d", "def", totals.DEFENCE)) for n in ns] + [f"round(g.{n}_{k}, 5) AS goalie_{n}_w{k}" for k in W for n in slate.GOALIE_RATES]
    return _vector_sql().split("\nSELECT s.game_id")[0] + f""", both_ways AS (SELECT game_id, season, date, home AS team, away AS opp, 1.0 AS is_home, 5.0 + game_id % 3 AS env FROM slates UNION ALL SELECT game_id, season, date, away, home, 0.0, 5.0 + game_id % 3 FROM slates)
SELECT s.game_id, s.team, s.is_home, {", ".join(names)}, CAST(o.games_5 AS DOUBLE) AS off_gp_w5, CAST(d.games_5 AS DOUBLE) AS def_gp_w5, CAST(s.team - s.opp AS DOUBLE) AS elo_edge, CASE WHEN s.game_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS is_playoff, 0.0 AS starter_fallback
FROM both_ways s JOIN rates o ON o.team = s.team AND o.date = s.date JOIN rates d ON d.team = s.opp AND d.date = s.date JOIN starts st ON st.team = s.opp AND st.date = s.date JOIN goalies g ON g.goalie_id = st.goalie_id AND g.date = s.date"""


@query(_attack_sql())
def attack_rows(spark, d):
    """Both attacks of every slate game, goal rates against the league's of the day."""
    base, _, slates, units = _sides(spark, d)
    first = units.filter("is_starter").select("game_id", "season", "date", "team", "goalie_id")
    goalie = slate.goalie_asof(units, slates.join(first, ["game_id", "season", "date"]).select("game_id", "season", "date", "goalie_id"), slate.league_priors(units, F.col("season") + 1), W)
    of = lambda side, name: first.select("game_id", F.col("team").alias(side), F.col("goalie_id").alias(name))
    games = slates.join(of("home", "home_starter"), ["game_id", "home"]).join(of("away", "away_starter"), ["game_id", "away"])
    games = games.withColumns({"env": (5 + F.pmod("game_id", F.lit(3))).cast("double"), "game_type": F.when(F.pmod("game_id", F.lit(2)) == 0, 3).otherwise(2), "stage": F.lit("MID")} | {f"{p}_{c}": F.lit(None).cast(t) for p in ("home", "away") for c, t in (("score", "int"), ("rest", "int"), ("b2b", "boolean"), ("travel_km", "double"), ("game_num", "int"))} | {"home_elo": F.col("home").cast("double"), "away_elo": F.col("away").cast("double")})
    out = totals.attack_rows(games, slate.team_asof(base, slates, W), goalie, W, env="env")
    shown = [f"{q}_{n}_w{k}" for k in W for q, ns in (("off", totals.ATTACK), ("def", totals.DEFENCE)) for n in ns] + [f"goalie_{n}_w{k}" for k in W for n in slate.GOALIE_RATES]
    return out.select("game_id", "team", "is_home", *[F.round(c, 5).alias(c) for c in shown], "off_gp_w5", "def_gp_w5", "elo_edge", "is_playoff", "starter_fallback")
