"""Queries of player features on the driver's tables, and the same in SQL.

Suppliers are skaters, of the side (key + year) % 8, who play on days on which they sell; side t is at home to side t + 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretime.plans import players
from foretime.plans.queries import query, r6
from foretime.sources.shared import small_step, step
from foretime.sources.tables import driver_table

SKATER_SQL = """
sold AS (
  SELECT CAST(l_suppkey AS BIGINT) AS player_id, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS season, CAST(CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS BIGINT) AS day, l_quantity AS q, l_partkey AS part, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), skaters AS (
  SELECT player_id, date, season, day, CAST((player_id + season) % 8 AS INT) AS team, sum(q) * 30 AS toi_seconds, count(*) + sum(r) AS shots, sum(part % 100) AS pp0, sum(part % 50) AS sh0, sum(line) AS fow0, count(*) AS fol0, (player_id + day) % 11 > 0 AS known
  FROM sold GROUP BY player_id, date, season, day
), games AS (
  SELECT h.day * 10 + h.team AS game_id, h.season, h.date, CASE WHEN h.day % 50 = 0 THEN 1 ELSE 2 END AS game_type, h.team AS home, a.team AS away FROM (SELECT DISTINCT day, date, season, team FROM skaters) h JOIN (SELECT DISTINCT day, team FROM skaters) a ON h.day = a.day AND a.team = h.team + 4
), p AS (
  SELECT player_id, g.game_id, s.season, s.date, team, CASE WHEN team < 4 THEN team + 4 ELSE team - 4 END AS opp, CASE WHEN player_id % 3 = 0 THEN 'D' ELSE 'F' END AS pos, CAST(toi_seconds AS DOUBLE) AS toi, CAST(shots AS DOUBLE) AS sog, CASE WHEN known THEN CAST(pp0 AS DOUBLE) END AS pp_toi, CASE WHEN known THEN CAST(sh0 AS DOUBLE) END AS sh_toi,
    CASE WHEN known THEN CAST(fow0 AS DOUBLE) END AS fow, CASE WHEN known THEN CAST(fol0 AS DOUBLE) END AS fol, CASE WHEN g.game_id % 7 > 0 AND count(*) FILTER (WHERE player_id % 5 > 0) OVER (PARTITION BY g.game_id) > 0 THEN CASE WHEN player_id % 5 > 0 THEN shots + 2.0 ELSE 0.0 END END AS att,
    CASE WHEN g.game_id % 7 > 0 AND count(*) FILTER (WHERE player_id % 5 > 0) OVER (PARTITION BY g.game_id) > 0 THEN 1.0 ELSE 0.0 END AS att_known, s.day
  FROM skaters s JOIN games g ON g.game_id = s.day * 10 + s.team % 4 WHERE game_type = 2
), strong AS (
  SELECT p.*, CASE WHEN att_known = 1 THEN coalesce(pps, 0) END AS pp_sog, CASE WHEN att_known = 1 THEN coalesce(alls, 0) END AS all_sog
  FROM p LEFT JOIN (SELECT player_id, day, CAST(count(*) FILTER (WHERE line % 3 = 0) AS DOUBLE) AS pps, CAST(count(*) AS DOUBLE) AS alls FROM sold GROUP BY player_id, day) USING (player_id, day)
), totals AS (
  SELECT *, CASE WHEN count(*) FILTER (WHERE pp_toi IS NULL OR sh_toi IS NULL) OVER w = 0 THEN sum(pp_toi) OVER w / 5 END AS team_pp, CASE WHEN count(*) FILTER (WHERE pp_toi IS NULL OR sh_toi IS NULL) OVER w = 0 THEN sum(sh_toi) OVER w / 4 END AS team_pk FROM strong WINDOW w AS (PARTITION BY game_id, team)
), leagued AS (
  SELECT *, 3600 * (coalesce(sum(sog) OVER w, 0) + 360000 * CASE pos WHEN 'D' THEN 4.5::DOUBLE ELSE 7.0::DOUBLE END / 3600) / (coalesce(sum(toi) OVER w, 0) + 360000) AS rel, 3600 * (coalesce(sum(sog) OVER a, 0) + 360000 * 6.2::DOUBLE / 3600) / (coalesce(sum(toi) OVER a, 0) + 360000) AS league_sog60,
    (coalesce(sum(sog) OVER w, 0) + 2000 * CASE pos WHEN 'D' THEN 1.3::DOUBLE ELSE 1.9::DOUBLE END) / (count(*) OVER w + 2000) AS league_pg
  FROM totals WINDOW w AS (PARTITION BY pos ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), a AS (ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)
)"""
_FRAMES = ", ".join(f"w{n} AS (PARTITION BY player_id ORDER BY date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (5, 10, 20, 40)) + """,
  b AS (PARTITION BY player_id ORDER BY date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY player_id, season ORDER BY date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY player_id ORDER BY date, game_id)"""


def _rate(num: str, den: str, w: str, scale: str = "3600", by: str = "/ rel") -> str:
    return f"CASE WHEN sum({den}) OVER {w} > 0 THEN {scale} * sum({num}) OVER {w} / sum({den}) OVER {w} END {by}"


_STATS = "pp_toi IS NOT NULL AND sh_toi IS NOT NULL"
_BOTH = f"{_STATS} AND pp_sog IS NOT NULL"
_own = {f"sog60_l{n}_rel": _rate("sog", "toi", f"w{n}") for n in (5, 10, 20, 40)} | {f"att60_l{n}_rel": _rate("coalesce(att, 0)", "toi * att_known", f"w{n}") for n in (5, 10, 20, 40)}
_own |= {"sog60_season_rel": _rate("sog", "toi", "s"), "att60_season_rel": _rate("coalesce(att, 0)", "toi * att_known", "s")}
_own |= {f"toi_mean_l{n}": f"avg(toi) OVER w{n} / 60" for n in (5, 10)} | {f"toi_std_l{n}": f"CASE WHEN count(toi) OVER w{n} >= 2 THEN stddev_samp(toi) OVER w{n} END / 60" for n in (5, 10)}
_own |= {f"pp_toi_l{n}": f"avg(pp_toi) OVER w{n} / 60" for n in (5, 10, 20)} | {f"pp_share_l{n}": _rate(f"CASE WHEN {_STATS} AND team_pp IS NOT NULL THEN pp_toi ELSE 0 END", f"CASE WHEN {_STATS} AND team_pp IS NOT NULL THEN team_pp ELSE 0 END", f"w{n}", "1.0", "") for n in (5, 10, 20)}
_own |= {f"pk_toi_l{n}": f"avg(sh_toi) OVER w{n} / 60" for n in (10, 20)}
_own |= {"pp_sog60_l20_rel": _rate(f"CASE WHEN {_BOTH} THEN pp_sog ELSE 0 END", f"CASE WHEN {_BOTH} THEN pp_toi ELSE 0 END", "w20"), "pp_sog60_season_rel": _rate(f"CASE WHEN {_BOTH} THEN pp_sog ELSE 0 END", f"CASE WHEN {_BOTH} THEN pp_toi ELSE 0 END", "s")}
_own |= {"nonpp_sog60_l20_rel": _rate(f"CASE WHEN {_BOTH} THEN all_sog - pp_sog ELSE 0 END", f"CASE WHEN {_BOTH} THEN toi - pp_toi ELSE 0 END", "w20"), "es_toi_l10": "avg(toi - pp_toi - sh_toi) OVER w10 / 60", "fo_l20": "avg(fow + fol) OVER w20", "fo_win_l20": _rate("coalesce(fow, 0)", "coalesce(fow + fol, 0)", "w20", "1.0", "")}
_own |= {"shrunk_sog60": "3600 * (coalesce(sum(sog) OVER b, 0) + 18000 * rel / 3600) / (coalesce(sum(toi) OVER b, 0) + 18000)", "b0_mean": "CASE WHEN row_number() OVER o > 5 THEN avg(sog) OVER w10 ELSE league_pg END", "n_prior": "CAST(row_number() OVER o - 1 AS DOUBLE)"}
_own |= {"exp_toi": "greatest(least(avg(toi) OVER w10, max(toi) OVER w20), min(toi) OVER w20)"}
_SHOWN = [*_own, "league_pos_sog60", "league_sog60", "league_pos_sog_pg", "days_since_last", "team_games_missed", "b2b", "env_pos_sog60", "decay_index", "b3_mean", "team_pp_l10", "opp_pk_l10", "es_toi_rank_pct", "toi_rank_pct", "pp_rank", *[f"{t}_l{n}_rel" for n in (10, 20) for t in ("team_sf", "opp_sa")]]


def _features_sql() -> str:
    share = lambda c: f"CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) OVER g > 1 THEN (rank() OVER (PARTITION BY game_id, team, pos, {c} IS NULL ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY game_id, team, pos, {c}) - 1) / 2.0 - 1) / (count({c}) OVER g - 1) ELSE 0 END"
    return f"""WITH {SKATER_SQL}, own AS (
  SELECT *, lag(date) OVER o AS last_date, {", ".join(f"{e} AS {n}" for n, e in _own.items())} FROM leagued WINDOW {_FRAMES}
), began AS (SELECT season, pos, arg_min(rel, date) AS began FROM own GROUP BY season, pos
), days AS (SELECT season, pos, date, sum(sog) AS ds, sum(toi) AS dt FROM own GROUP BY season, pos, date
), level AS (SELECT season, pos, date, 3600 * (coalesce(sum(ds) OVER w, 0) + 6000000 * began / 3600) / (coalesce(sum(dt) OVER w, 0) + 6000000) AS env FROM days JOIN began USING (season, pos)
  WINDOW w AS (PARTITION BY season, pos ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), envs AS (SELECT own.*, env FROM own JOIN level USING (season, pos, date)
), decayed AS (
  SELECT a.player_id, a.game_id, coalesce(sum(b.sog * pow(0.5, (a.date - b.date) / 365.0)), 0) AS ds, coalesce(sum(b.toi * b.env / 3600 * pow(0.5, (a.date - b.date) / 365.0)), 0) AS de FROM envs a LEFT JOIN envs b ON a.player_id = b.player_id AND b.date < a.date GROUP BY a.player_id, a.game_id
), sched AS (SELECT home AS team, date, game_id FROM games WHERE game_type IN (2, 3) UNION ALL SELECT away, date, game_id FROM games WHERE game_type IN (2, 3)
), missed AS (SELECT e.player_id, e.game_id, count(s.game_id) AS n FROM envs e LEFT JOIN sched s ON s.team = e.team AND s.date > e.last_date AND s.date < e.date GROUP BY e.player_id, e.game_id
), tg AS (SELECT game_id, team, date, any_value(team_pp) AS team_pp, any_value(team_pk) AS team_pk FROM envs GROUP BY game_id, team, date
), tgr AS (SELECT game_id, team, avg(team_pp) OVER w / 60 AS team_pp_l10, avg(team_pk) OVER w / 60 AS pk FROM tg WINDOW w AS (PARTITION BY team ORDER BY date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
), ts AS (SELECT g.game_id, s.team, g.date, CAST(sum(shots) AS DOUBLE) AS sf FROM skaters s JOIN games g ON g.game_id = s.day * 10 + s.team % 4 WHERE game_type = 2 GROUP BY g.game_id, s.team, g.date
), tsa AS (SELECT a.*, b.sf AS sa FROM ts a JOIN ts b ON a.game_id = b.game_id AND a.team <> b.team
), tsl AS (SELECT *, (coalesce(sum(sf) OVER w, 0) + 100 * 30.0::DOUBLE) / (count(sf) OVER w + 100) AS lg FROM tsa WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)
), tf AS (SELECT game_id, team, avg(sf) OVER w10 / lg AS sf10, avg(sf) OVER w20 / lg AS sf20, avg(sa) OVER w10 / lg AS sa10, avg(sa) OVER w20 / lg AS sa20 FROM tsl
  WINDOW w10 AS (PARTITION BY team ORDER BY date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w20 AS (PARTITION BY team ORDER BY date, game_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
), done AS (
  SELECT e.*, rel AS league_pos_sog60, league_pg AS league_pos_sog_pg, CAST(e.date - last_date AS DOUBLE) AS days_since_last, CASE WHEN last_date IS NOT NULL THEN CAST(m.n AS DOUBLE) END AS team_games_missed,
    CASE WHEN EXISTS (SELECT 1 FROM sched s WHERE s.team = e.team AND s.date = e.date - 1) THEN 1.0 ELSE 0.0 END AS b2b, env AS env_pos_sog60, (ds + 18000 * env / 3600) / (de + 18000 * env / 3600) AS decay_index, (ds + 18000 * env / 3600) / (de + 18000 * env / 3600) * env * exp_toi / 3600 AS b3_mean,
    t.team_pp_l10, u.pk AS opp_pk_l10, {share("es_toi_l10")} AS es_toi_rank_pct, {share("toi_mean_l10")} AS toi_rank_pct, CASE WHEN pp_toi_l10 IS NOT NULL THEN CAST(rank() OVER (PARTITION BY e.game_id, e.team ORDER BY pp_toi_l10 DESC NULLS LAST) AS DOUBLE) END AS pp_rank, f.sf10 AS team_sf_l10_rel, f.sf20 AS team_sf_l20_rel, x.sa10 AS opp_sa_l10_rel, x.sa20 AS opp_sa_l20_rel
  FROM envs e JOIN decayed d USING (player_id, game_id) JOIN missed m USING (player_id, game_id) LEFT JOIN tgr t ON t.game_id = e.game_id AND t.team = e.team LEFT JOIN tgr u ON u.game_id = e.game_id AND u.team = e.opp
    LEFT JOIN tf f ON f.game_id = e.game_id AND f.team = e.team LEFT JOIN tf x ON x.game_id = e.game_id AND x.team = e.opp WINDOW g AS (PARTITION BY e.game_id, e.team, pos)
)
SELECT player_id, game_id, {", ".join(f"round({c}, 7) AS {c}" for c in _SHOWN)} FROM done""".replace("PARTITION BY game_id, team, pos, es", "PARTITION BY e.game_id, e.team, pos, es").replace("PARTITION BY game_id, team, pos, toi", "PARTITION BY e.game_id, e.team, pos, toi")


def _frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The inputs of player_features."""
    o, li = driver_table(spark, d, "orders"), driver_table(spark, d, "lineitem")
    # lines and orders are made narrow before they meet
    li = li.select("l_orderkey", F.col("l_suppkey").cast("long").alias("player_id"), F.col("l_quantity").alias("q"), F.pmod("l_partkey", F.lit(100)).alias("part"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").cast("int").alias("r"))
    o = o.select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("player_id", "date").agg(
        (F.sum("q") * 30).alias("toi_seconds"), (F.count(F.lit(1)) + F.sum("r")).alias("shots"), F.sum("part").alias("pp_toi"), F.sum(F.pmod("part", F.lit(50))).alias("sh_toi"), F.sum("line").alias("fow"), F.count(F.lit(1)).alias("fol"), F.count_if(F.pmod("line", F.lit(3)) == 0).alias("strong"), F.count(F.lit(1)).alias("n")
    ).withColumn("day", F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long"))
    rows = rows.withColumns({"season": F.year("date"), "team": F.pmod(F.col("player_id") + F.year("date"), F.lit(8)).cast("int"), "position": F.when(F.pmod("player_id", F.lit(3)) == 0, "D").otherwise("C"), "stats_known": F.pmod(F.col("player_id") + F.col("day"), F.lit(11)) > 0}).withColumn("game_id", F.col("day") * 10 + F.pmod("team", F.lit(4)))
    rows = step(rows, "skaters")  # all inputs are made of these
    games = rows.groupBy("game_id", "season", "date", "day").agg(F.min("team").alias("home"), F.max("team").alias("away")).filter("home < away")
    games = games.withColumns({"game_type": F.when(F.pmod("day", F.lit(50)) == 0, 1).otherwise(2), "state": F.lit("FINAL")}).drop("day")
    games = small_step(games, "games")
    played = rows.drop("season", "date").join(games.select("game_id"), "game_id")
    covered = played.filter(F.pmod("game_id", F.lit(7)) > 0)
    shots = covered.select("game_id", "player_id", F.inline(F.array(F.struct(F.lit("5v4").alias("strength"), F.col("strong").alias("n")), F.struct(F.lit("5v5").alias("strength"), (F.col("n") - F.col("strong")).alias("n")))))
    return {
        "skaters": played, "games": games, "attempts": covered.filter(F.pmod("player_id", F.lit(5)) > 0).select("game_id", "player_id", (F.col("shots") + 2).alias("attempts")),
        "team_games": played.groupBy("game_id", "team").agg(F.sum("shots").alias("sog")), "shots": shots,
    }


@query(_features_sql())
def player_features(spark, d):
    """All features of a skater before a game."""
    out = players.player_features(**_frames(spark, d))
    return out.select("player_id", "game_id", *[F.round(c, 7).alias(c) for c in _SHOWN])


@query(f"""WITH {SKATER_SQL}, x AS (SELECT *, CASE WHEN att_known = 1 THEN CASE WHEN player_id % 5 > 0 THEN CAST(shots0 AS DOUBLE) / 8 ELSE 0 END ELSE 0 END AS x, toi * att_known AS t, CASE WHEN att_known = 1 THEN att ELSE 0 END AS a FROM (SELECT *, sog AS shots0 FROM leagued)
), l AS (SELECT *, CASE WHEN sum(t) OVER w > 0 THEN nullif(3600 * sum(x) OVER w / sum(t) OVER w, 0) END AS pos_rate, CASE WHEN sum(a) OVER y > 0 THEN nullif(sum(x) OVER y / sum(a) OVER y, 0) END AS quality FROM x
  WINDOW w AS (PARTITION BY pos ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), y AS (ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)
), own AS (SELECT *, {_rate("x", "t", "w10", by="/ pos_rate")} AS i10, {_rate("x", "t", "w20", by="/ pos_rate")} AS i20, {_rate("x", "t", "s", by="/ pos_rate")} AS i_s, {_rate("x", "a", "w20", "1.0", "/ quality")} AS q20 FROM l WINDOW {_FRAMES}
), sides AS (SELECT game_id, date, team, opp, sum(x) AS xs, max(att_known) AS k FROM x GROUP BY game_id, date, team, opp
), against AS (SELECT a.game_id, a.date, a.team, a.k, CASE WHEN a.k = 1 THEN coalesce(b.xs, 0) ELSE 0 END AS v FROM sides a LEFT JOIN sides b ON a.game_id = b.game_id AND a.opp = b.team
), lg AS (SELECT *, CASE WHEN sum(k) OVER w > 0 THEN nullif(sum(v) OVER w / sum(k) OVER w, 0) END AS lg FROM against WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)
), opp AS (SELECT game_id, team, CASE WHEN sum(k) OVER w > 0 THEN sum(v) OVER w / sum(k) OVER w END / lg AS oxga FROM lg WINDOW w AS (PARTITION BY team ORDER BY date, game_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT player_id, own.game_id, round(i10, 6) AS ixg60_l10_rel, round(i20, 6) AS ixg60_l20_rel, round(i_s, 6) AS ixg60_season_rel, round(q20, 6) AS xg_per_att_l20_rel, round(oxga, 6) AS opp_xga_l20_rel FROM own LEFT JOIN opp ON opp.game_id = own.game_id AND opp.team = own.opp""")
def player_xg(spark, d):
    """Expected goals of a skater and of his opponent, against the league; four of five skaters have shots, in games that are covered."""
    f = _frames(spark, d)
    # what the expected goals go by, and no more: shots by strength make no difference
    rows = players.played_rows(f["skaters"], f["games"], f["attempts"]).select("player_id", "game_id", "season", "date", "team", "opp", "pos_group", "toi", "att")
    shots = f["skaters"].filter((F.pmod("game_id", F.lit(7)) > 0) & (F.pmod("player_id", F.lit(5)) > 0)).select("game_id", F.col("player_id").alias("shooter_id"), "team", (F.col("shots") / 8).alias("xg"))
    out = players.player_xg_features(rows, shots)
    return out.select("player_id", "game_id", *[r6(c, c) for c in players.XG_FEATURES])
