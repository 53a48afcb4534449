"""How firmly a goalie holds his place, and what he carries with him, from games strictly before a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.operators.pit import day_sums
from foretime.plans.features import starters

#: How many of the team's games and of his own appearances count, and what stands in for an empty league.
SHARE_GAMES, SHARE_LEAST, ALT_GAMES, REST_CAP = 10, 3, 20, 10
CARRY_ROWS, CARRY_K, LEAGUE_DAYS = 60, 30.0, 365
LEAGUE_SV, LEAGUE_SHOTS = 0.905, 28.0
FEATURES = ("role_start_share_10", "role_start_share_season", "role_is_primary", "role_rest_days", "role_started_yesterday", "role_carry_sv", "role_starter_minus_alt")


def last_before(asked: DataFrame, facts: DataFrame, keys: list[str], name: str, values: list[str], order: list[str]) -> DataFrame:
    """asked (with keys and date) with name: a struct of the values of the last fact of its keys on an earlier day. Facts of a day are taken in order.

    Both are put in one line by day, a day's questions before its facts, and the last fact is carried along.
    """
    f = facts.select(*keys, F.col("date").alias("__d"), F.lit(1).alias("__k"), F.struct(*order).alias("__o"), F.struct(*values).alias("__v"), F.lit(None).cast(asked.select(F.struct(*asked.columns)).schema[0].dataType).alias("__q"))
    q = asked.select(*keys, F.col("date").alias("__d"), F.lit(0).alias("__k"), F.lit(None).cast(f.schema["__o"].dataType).alias("__o"), F.lit(None).cast(f.schema["__v"].dataType).alias("__v"), F.struct(*asked.columns).alias("__q"))
    w = Window.partitionBy(*keys).orderBy("__d", "__k", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = f.unionByName(q).withColumn("__seen", F.last("__v", ignorenulls=True).over(w)).filter("__k = 0")
    return both.select("__q.*", F.col("__seen").alias(name))


def carried_share(asked: DataFrame, app: DataFrame, goalie: str = "goalie_id", name: str = "carry") -> DataFrame:
    """asked (goalie, date) with name: the save share of his last CARRY_ROWS appearances, with CARRY_K appearances of the league's of the year before; the league's for one who hasn't appeared."""
    own = Window.partitionBy("goalie_id").orderBy("date", "game_id").rowsBetween(1 - CARRY_ROWS, 0)
    facts = app.select("goalie_id", "date", "game_id", F.sum("saves").over(own).alias("s"), F.sum("shots").over(own).alias("a"))
    rows = last_before(asked.withColumn("__g", F.col(goalie)), facts.withColumnRenamed("goalie_id", "__g"), ["__g"], "__own", ["s", "a"], ["game_id"]).drop("__g")
    # the league by day: questions are rows without saves
    days = app.groupBy("date").agg(F.sum("saves").cast("double").alias("__s"), F.sum("shots").cast("double").alias("__a"), F.count(F.lit(1)).cast("double").alias("__n"))
    wanted = rows.select("date").distinct().join(days.select("date"), "date", "left_anti").withColumns({c: F.lit(0.0) for c in ("__s", "__a", "__n")})
    league = day_sums(days.unionByName(wanted).withColumn("__all", F.lit(0)), ["__all"], "date", ["__s", "__a", "__n"], {"lg": (-LEAGUE_DAYS, -1)})
    known = (F.col("__n_sum_lg") > 0) & (F.col("__a_sum_lg") > 0)
    league = league.select("date", F.when(known, F.col("__s_sum_lg") / F.col("__a_sum_lg")).otherwise(LEAGUE_SV).alias("__p"), F.when(known, F.col("__a_sum_lg") / F.col("__n_sum_lg")).otherwise(LEAGUE_SHOTS).alias("__bar"))
    prior = CARRY_K * F.col("__bar")
    of = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    share = F.when(F.col("__own").isNull(), F.col("__p")).otherwise((of("__own.s") + prior * F.col("__p")) / (of("__own.a") + prior))
    return rows.join(league, "date").withColumn(name, share).drop("__own", "__p", "__bar")


def role_features(app: DataFrame, asked: DataFrame, season_before: Column | None = None) -> DataFrame:
    """asked (game_id, team, goalie_id, date, season) with FEATURES, of appearances (game_id, team, goalie_id, date, season, is_starter, toi, saves, shots) on earlier days.

    All are NULL where the goalie isn't known. A team's games are numbered, so the last ones of a game are found by their numbers.
    """
    first = starters(app.select("team", "game_id", "goalie_id", "date", "season", "is_starter", "toi"))
    by_team = Window.partitionBy("team").orderBy("date", "game_id")
    by_season = Window.partitionBy("team", "season").orderBy("date", "game_id")
    so_far = by_season.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    games = first.select("team", "season", "date", "game_id", "goalie_id", F.row_number().over(by_team).alias("k"), F.row_number().over(by_season).alias("ks"), F.row_number().over(Window.partitionBy("team", "season", "goalie_id").orderBy("date", "game_id")).alias("own"))
    games = games.withColumn("most", F.max("own").over(so_far))
    rows = asked.select("game_id", "team", "goalie_id", "date", "season").filter("goalie_id IS NOT NULL").withColumn("__before", F.col("season") - 10001 if season_before is None else season_before)
    rows = last_before(rows, games, ["team"], "__t", ["k"], ["game_id"])
    rows = last_before(rows, games, ["team", "season"], "__s", ["ks", "most"], ["game_id"])
    rows = last_before(rows, games, ["team", "season", "goalie_id"], "__m", ["own"], ["game_id"])
    # the whole season before, where this one has no game yet
    past = games.groupBy("team", F.col("season").alias("__before")).agg(F.max("most").alias("__most_then"))
    mine = games.groupBy("team", F.col("season").alias("__before"), "goalie_id").agg(F.max("own").alias("__own_then"))
    rows = rows.join(past, ["team", "__before"], "left").join(mine, ["team", "__before", "goalie_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    primary = F.when(F.col("__s").isNotNull(), zero("__m.own") >= F.col("__s.most")).when(F.col("__most_then").isNotNull(), zero("__own_then") >= F.col("__most_then"))
    seen = app.select("goalie_id", "date", "game_id").withColumn("on", F.col("date"))
    rows = last_before(rows, seen, ["goalie_id"], "__l", ["on"], ["game_id"])
    gap = F.datediff("date", "__l.on")
    rows = rows.withColumns({"role_start_share_season": F.when(F.col("__s").isNotNull(), zero("__m.own") / F.col("__s.ks")), "role_is_primary": primary.cast("double"), "role_rest_days": F.when(gap.isNotNull(), F.least(gap, F.lit(REST_CAP))).cast("double"), "role_started_yesterday": F.coalesce((gap == 1).cast("double"), F.lit(0.0))})
    # the team's last games by number: at most ALT_GAMES rows for each question
    key = ["game_id", "team", "goalie_id", "date"]
    n = F.col("__t.k")
    each = rows.filter(F.col("__t").isNotNull()).select(*key, n.alias("n"), F.explode(F.sequence(F.greatest(n - (ALT_GAMES - 1), F.lit(1)), n)).alias("k"))
    each = each.join(games.select("team", "k", F.col("goalie_id").alias("who")), ["team", "k"])
    recent = F.col("k") > F.col("n") - SHARE_GAMES
    share = each.groupBy(*key).agg(F.when(F.max("n") >= SHARE_LEAST, F.avg(F.when(recent, (F.col("who") == F.col("goalie_id")).cast("double")))).alias("role_start_share_10"))
    other = each.filter(F.col("who") != F.col("goalie_id")).groupBy(*key, "who").agg(F.count(F.lit(1)).alias("c"), F.max("k").alias("last"))
    alt = other.groupBy(*key).agg(F.max_by("who", F.struct("c", "last")).alias("alt"))
    rows = carried_share(rows, app, "goalie_id", "role_carry_sv").join(share, key, "left")
    alt = carried_share(alt, app, "alt", "__alt")
    rows = rows.join(alt.select(*key, "__alt"), key, "left").withColumn("role_starter_minus_alt", F.coalesce(F.col("role_carry_sv") - F.col("__alt"), F.lit(0.0)))
    return asked.join(rows.select(*key, *FEATURES), key, "left")


def defending_roles(games: DataFrame, app: DataFrame, season_before: Column | None = None) -> DataFrame:
    """games (game_id, date, season, home, away, home_starter, away_starter) with home_def_* and away_def_*: the role of the goalie that each side attacks, so home_def is the visitors' starter."""
    side = lambda team, goalie, at: F.struct(F.col(team).alias("team"), F.col(goalie).alias("goalie_id"), F.lit(at).alias("attack"))
    asked = games.select("game_id", "date", "season", F.inline(F.array(side("away", "away_starter", "home"), side("home", "home_starter", "away"))))
    roles = role_features(app, asked, season_before)
    by = roles.groupBy("game_id").agg(*[F.max(F.when(F.col("attack") == a, F.col(f))).alias(f"{a}_def_{f}") for a in ("home", "away") for f in FEATURES])
    return games.join(by, "game_id", "left")
