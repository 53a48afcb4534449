"""Features of a player before a game: his own rates against a moving league level, minutes, usage, special teams, schedule.

Rows of players look back by rows (all windows of a player share one sort); what the league does looks back by days,
over sums by day. A statistic that isn't known is NULL and is left out of sums; it never counts as zero.

Only what was played is shuffled and written; the features, several times as wide, come last, where the rows of a player
lie together. What holds for a day or a side of a game is a table of its own that meets the rows there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from foretime.functions.calendar import day_number
from foretime.functions.guards import per60, ratio
from foretime.functions.text import strength
from foretime.operators.pit import day_sums
from foretime.operators.reshape import sides
from foretime.sources.shared import dealt, small_step, step

#: How far back the windows go, in rows of the player or the team.
RATE_ROWS, TOI_ROWS, TEAM_ROWS = (5, 10, 20, 40), (5, 10), (10, 20)
PP_ROWS, PK_ROWS = (5, 10, 20), (10, 20)
#: The pseudo-time, -games and -rates that keep a league's level defined in its first days.
LEAGUE_DAYS = 365
PRIOR_SECONDS, PRIOR_GAMES, TEAM_PRIOR_GAMES, TEAM_PRIOR_SOG = 6000 * 60, 2000, 100, 30.0
PRIOR_SOG60 = {"F": 7.0, "D": 4.5, "ALL": 6.2}
PRIOR_SOG_PG = {"F": 1.9, "D": 1.3}
SHRINK_SECONDS, ENV_SECONDS, HALF_LIFE_DAYS = 300 * 60, 100_000 * 60, 365.0
#: Skaters on the ice in a power play and in killing one.
PP_SKATERS, PK_SKATERS = 5, 4


def is_power_play(code: Column) -> Column:
    """Whether `AvB` (own skaters, the other side's) has more own skaters against at most four."""
    men = strength(code)
    return F.coalesce((men["own"] > men["other"]) & (men["other"] <= 4), F.lit(False))


def played_rows(skaters: DataFrame, games: DataFrame, attempts: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """A row for each skater who played in a finished game: sog, toi, att and, by strength, pp_sog and all_sog.

    skaters: player_id, game_id, team, position, toi_seconds, shots, pp_toi, sh_toi, fow, fol, stats_known. attempts: game_id, player_id,
    attempts; a game that it doesn't cover is unknown, a player without a row in one that it covers has none. shots: game_id,
    player_id, strength, n.
    """
    final = games.filter(F.col("state").isin("FINAL", "OFF") & F.col("game_type").isin(2, 3)).select("game_id", "season", "date", "game_type", "home", "away")
    known = F.coalesce("stats_known", F.lit(False))
    df = skaters.join(final, "game_id").filter((F.coalesce("toi_seconds", F.lit(0)) > 0) & F.col("shots").isNotNull())
    df = df.withColumns({c: F.when(known, F.col(c).cast("double")) for c in ("pp_toi", "sh_toi", "fow", "fol")} | {"toi": F.col("toi_seconds").cast("double"), "sog": F.col("shots").cast("double"), "is_d": (F.upper(F.trim("position")) == "D").cast("double")})
    df = df.withColumns({"pos_group": F.when(F.col("is_d") == 1, "D").otherwise("F"), "is_home": (F.col("team") == F.col("home")).cast("double")}).withColumn("opp", F.when(F.col("is_home") == 1, F.col("away")).otherwise(F.col("home")))
    covered = small_step(attempts.select("game_id").distinct(), "covered").withColumn("covered", F.lit(True))
    # all sides are dealt by player, and so are the rows that come out
    df = df.repartition("player_id").join(attempts.select("game_id", "player_id", F.col("attempts").cast("double").alias("att")).repartition("player_id"), ["game_id", "player_id"], "left").join(covered, "game_id", "left")
    of_covered = lambda c: F.when(F.col("covered"), F.coalesce(c, F.lit(0.0)))
    if shots is None:
        df = df.withColumns({"pp_sog": F.lit(None).cast("double"), "all_sog": F.lit(None).cast("double")})
    else:
        n = F.col("n").cast("double")
        by = shots.select("game_id", "player_id", F.when(is_power_play(F.col("strength")), n).otherwise(0.0).alias("pp"), n.alias("n")).repartition("player_id")
        by = by.groupBy("game_id", "player_id").agg(F.sum("pp").alias("pp_sog"), F.sum("n").alias("all_sog"))
        df = df.join(by, ["game_id", "player_id"], "left").withColumns({c: of_covered(F.col(c)) for c in ("pp_sog", "all_sog")})
    df = df.withColumns({"att": of_covered(F.col("att")), "att_known": F.coalesce(F.col("covered"), F.lit(False)).cast("double")})
    return df.select("player_id", "game_id", "season", "date", "game_type", "team", "opp", "pos_group", "is_d", "is_home", "toi", "sog", "att", "att_known", "pp_sog", "all_sog", "pp_toi", "sh_toi", "fow", "fol")


def _by_group(values: dict[str, float]) -> Column:
    return F.when(F.col("pos_group") == "D", F.lit(values["D"])).otherwise(F.lit(values["F"]))


def _meets(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of table, which has a row for each key; an unknown key meets the unknown one."""
    table = table.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(table[f"__key_{k}"])
    return df.join(table, same, "left").drop(*[f"__key_{k}" for k in keys])


def league_levels(df: DataFrame) -> DataFrame:
    """A row for each season, pos_group and date of df with the league's rates of the year before, its pseudo-time added, by position (league_pos_sog60, league_pos_sog_pg) and of all (league_sog60), and the season's level to date shrunk to the one it began with (env_pos_sog60)."""
    by = step(df.groupBy("season", "pos_group", "date").agg(F.sum("sog").alias("sog"), F.sum("toi").alias("toi"), F.count(F.lit(1)).alias("n")), "league-days")
    by = day_sums(by, ["pos_group"], "date", ["sog", "toi", "n"], {"pos": (-LEAGUE_DAYS, -1)})
    by = day_sums(by.withColumn("__all", F.lit(0)), ["__all"], "date", ["sog", "toi"], {"all": (-LEAGUE_DAYS, -1)})
    by = day_sums(by, ["season", "pos_group"], "date", ["sog", "toi"], {"env": (None, -1)})
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    level = lambda f, prior: 3600 * (known(f"sog_sum_{f}") + PRIOR_SECONDS * prior / 3600.0) / (known(f"toi_sum_{f}") + PRIOR_SECONDS)
    out = by.withColumns({
        "league_pos_sog60": level("pos", _by_group(PRIOR_SOG60)),
        "league_sog60": level("all", F.lit(PRIOR_SOG60["ALL"])),
        "league_pos_sog_pg": (known("sog_sum_pos") + PRIOR_GAMES * _by_group(PRIOR_SOG_PG)) / (F.coalesce("n_sum_pos", F.lit(0)) + PRIOR_GAMES),
    })
    began = F.min_by("league_pos_sog60", "date").over(Window.partitionBy("season", "pos_group"))  # of its first day
    env = 3600 * (known("sog_sum_env") + ENV_SECONDS * F.col("__began") / 3600.0) / (known("toi_sum_env") + ENV_SECONDS)
    return out.withColumn("__began", began).select("season", "pos_group", "date", "league_pos_sog60", "league_sog60", "league_pos_sog_pg", env.alias("env_pos_sog60"))


def team_minutes(df: DataFrame) -> DataFrame:
    """A row for each game and team of df: the seconds of its power plays (team_pp) and of killing them (team_pk), unknown when those of any skater are, and the minutes of both over its ten games before (team_pp_l10, team_pk_l10)."""
    all_known = F.count_if(F.col("pp_toi").isNull() | F.col("sh_toi").isNull()) == 0
    tg = df.groupBy("game_id", "team", "date").agg(F.when(all_known, F.sum("pp_toi") / PP_SKATERS).alias("team_pp"), F.when(all_known, F.sum("sh_toi") / PK_SKATERS).alias("team_pk"))
    w = Window.partitionBy("team").orderBy("date", "game_id").rowsBetween(-10, -1)
    return tg.withColumns({f"{c}_l10": F.avg(c).over(w) / 60 for c in ("team_pp", "team_pk")}).drop("date")


def _own_order(day: str = "date") -> WindowSpec:
    return Window.partitionBy("player_id").orderBy(day, "game_id")


def _lineup_minutes(order: WindowSpec) -> dict[str, Column]:
    mean = lambda c: F.avg(c).over(order.rowsBetween(-10, -1)) / 60
    return {"es_toi_l10": mean(F.col("toi") - F.col("pp_toi") - F.col("sh_toi")), "toi_mean_l10": mean("toi"), "pp_toi_l10": mean("pp_toi"), "last_date": F.lag("date").over(order)}


def own_history(df: DataFrame) -> DataFrame:
    """df (with league levels and team minutes) with all features that come from the player's earlier rows."""
    df = df.withColumn("__day", day_number(F.col("date")))  # decayed_level looks back by it: one sort serves both
    order = _own_order("__day")
    last = lambda n: order.rowsBetween(-n, -1)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    season = Window.partitionBy("player_id", "season").orderBy("__day", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    s = lambda c, w: F.sum(c).over(w)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    stats_ok = F.col("pp_toi").isNotNull() & F.col("sh_toi").isNotNull()
    share_ok, both = stats_ok & F.col("team_pp").isNotNull(), stats_ok & F.col("pp_sog").isNotNull()
    known = lambda ok, c: F.when(ok, c).otherwise(0.0)
    df = df.withColumns({
        "__att0": F.coalesce("att", F.lit(0.0)), "__att_toi": F.col("toi") * F.col("att_known"), "__pp_num": known(share_ok, F.col("pp_toi")), "__pp_den": known(share_ok, F.col("team_pp")), "__pps": known(both, F.col("pp_sog")), "__ppt": known(both, F.col("pp_toi")),
        "__nps": known(both, F.col("all_sog") - F.col("pp_sog")), "__npt": known(both, F.col("toi") - F.col("pp_toi")), "__fo": F.col("fow") + F.col("fol"), "__fow0": F.coalesce("fow", F.lit(0.0)), "__fo0": F.coalesce(F.col("fow") + F.col("fol"), F.lit(0.0)),
    })
    rel, mean = F.col("league_pos_sog60"), lambda c, n: F.avg(c).over(last(n))
    # seasons have a sort of their own, which comes while rows are narrow: the filter, true of all rows, keeps Spark from moving it behind the windows below
    df = df.withColumns({
        "sog60_season_rel": per60(s("sog", season), s("toi", season)) / rel, "att60_season_rel": per60(s("__att0", season), s("__att_toi", season)) / rel, "pp_sog60_season_rel": per60(s("__pps", season), s("__ppt", season)) / rel,
        "__nth": F.count(F.lit(1)).over(season),
    }).filter("__nth >= 0")
    out: dict[str, Column] = {
        "n_prior": (F.row_number().over(order) - 1).cast("double"),
        "__first": F.min("__day").over(before),
        "shrunk_sog60": 3600 * (zero("sog", before) + SHRINK_SECONDS * rel / 3600.0) / (zero("toi", before) + SHRINK_SECONDS),
        "exp_toi": F.greatest(F.least(mean("toi", 10), F.max("toi").over(last(20))), F.min("toi").over(last(20))),
        "b0_mean": F.when(F.row_number().over(order) > 5, mean("sog", 10)).otherwise(F.col("league_pos_sog_pg")),
    }
    for n in RATE_ROWS:
        out |= {f"sog60_l{n}_rel": per60(s("sog", last(n)), s("toi", last(n))) / rel, f"att60_l{n}_rel": per60(s("__att0", last(n)), s("__att_toi", last(n))) / rel}
    for n in TOI_ROWS:
        out |= {f"toi_mean_l{n}": mean("toi", n) / 60, f"toi_std_l{n}": F.when(F.count("toi").over(last(n)) >= 2, F.stddev_samp("toi").over(last(n))) / 60}
    for n in PP_ROWS:
        out |= {f"pp_toi_l{n}": mean("pp_toi", n) / 60, f"pp_share_l{n}": ratio(s("__pp_num", last(n)), s("__pp_den", last(n)))}
    out |= {f"pk_toi_l{n}": mean("sh_toi", n) / 60 for n in PK_ROWS}
    out |= {
        "pp_sog60_l20_rel": per60(s("__pps", last(20)), s("__ppt", last(20))) / rel, "nonpp_sog60_l20_rel": per60(s("__nps", last(20)), s("__npt", last(20))) / rel,
        "fo_l20": mean("__fo", 20), "fo_win_l20": ratio(s("__fow0", last(20)), s("__fo0", last(20))),
    }
    return df.withColumns(out | _lineup_minutes(order)).withColumn("days_since_last", F.datediff("date", "last_date").cast("double")).drop(*[c for c in df.columns if c.startswith("__") and c != "__day"])


def decayed_level(df: DataFrame) -> DataFrame:
    """df (of own_history) with the player's index against the season's level to date with a half-life of a year (decay_index), and the mean they expect (b3_mean).

    Days count from the player's first: the growing weight 2^(days / half-life) is summed and scaled back. Over 900 half-lives, where it would leave the range of doubles, are an error.
    """
    age = (F.col("__day") - F.coalesce("__first", "__day")) / F.lit(HALF_LIFE_DAYS)
    out = df.withColumn("__age", F.when(age <= 900, age).when(age > 900, F.raise_error(F.lit("a player spans over 900 half-lives")).cast("double")))
    earlier = Window.partitionBy("player_id").orderBy("__day").rangeBetween(Window.unboundedPreceding, -1)
    decayed = lambda c: F.coalesce(F.sum(c * F.pow(F.lit(2.0), F.col("__age"))).over(earlier), F.lit(0.0)) * F.pow(F.lit(2.0), -F.col("__age"))
    pseudo = SHRINK_SECONDS * F.col("env_pos_sog60") / 3600
    out = out.withColumn("decay_index", (decayed(F.col("sog")) + pseudo) / (decayed(F.col("toi") * F.col("env_pos_sog60") / 3600) + pseudo))
    return out.withColumn("b3_mean", F.col("decay_index") * F.col("env_pos_sog60") * F.col("exp_toi") / 3600).drop("__day", "__first", "__age")


def team_shots(team_games: DataFrame, games: DataFrame) -> DataFrame:
    """game_id, team, team_sf_l{n}_rel, team_sa_l{n}_rel: shots for and against over the team's games before, against the league's of the year before."""
    final = games.filter(F.col("state").isin("FINAL", "OFF") & F.col("game_type").isin(2, 3)).select("game_id", "date")
    w = Window.partitionBy("game_id")
    rows = team_games.select("game_id", "team", F.col("sog").cast("double").alias("sf")).join(final, "game_id")
    rows = rows.withColumns({"__sides": F.count(F.lit(1)).over(w), "sa": F.when(F.count("sf").over(w) == 2, F.sum("sf").over(w) - F.col("sf")).otherwise(F.when(F.col("sf").isNull(), F.sum("sf").over(w)))}).filter("__sides = 2").drop("__sides")
    rows = day_sums(rows.withColumn("__all", F.lit(0)), ["__all"], "date", ["sf"], {"lg": (-LEAGUE_DAYS, -1)})
    level = (F.coalesce("sf_sum_lg", F.lit(0.0)) + TEAM_PRIOR_GAMES * TEAM_PRIOR_SOG) / (F.coalesce("sf_n_lg", F.lit(0)) + TEAM_PRIOR_GAMES)
    order = Window.partitionBy("team").orderBy("date", "game_id")
    return rows.select("game_id", "team", *[(F.avg(c).over(order.rowsBetween(-n, -1)) / level).alias(f"team_{c}_l{n}_rel") for n in TEAM_ROWS for c in ("sf", "sa")])


def with_schedule(df: DataFrame, games: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """df (with last_date) with team_games_missed, the games of his present team since he last played, and b2b, whether it played the day before.

    The schedule is counted by team and day; the days of last games that it doesn't have are put in between, without games. asked: team and last_date of all rows of df, or of more, if they are to be had without df itself.
    """
    days = sides(games.filter(F.col("game_type").isin(2, 3)), ["date"], {"team": "home"}, {"team": "away"}).groupBy("team", "date").agg(F.count(F.lit(1)).alias("n"))
    asked = (df if asked is None else asked).filter("last_date IS NOT NULL").select("team", F.col("last_date").alias("date")).distinct().withColumn("n", F.lit(0).cast("long"))
    days = small_step(days, "schedule-days")
    upto = days.unionByName(asked).groupBy("team", "date").agg(F.sum("n").alias("n"))
    upto = small_step(upto.withColumn("upto", F.sum("n").over(Window.partitionBy("team").orderBy("date"))), "schedule")
    now = upto.select("team", "date", (F.col("upto") - F.col("n")).alias("__now"))
    then = upto.select("team", F.col("date").alias("last_date"), F.col("upto").alias("__then"))
    yesterday = days.select("team", F.date_add("date", 1).alias("date"), F.lit(1.0).alias("b2b"))
    out = df.join(now, ["team", "date"], "left").join(then, ["team", "last_date"], "left").join(yesterday, ["team", "date"], "left")
    missed = F.when(F.col("last_date").isNotNull(), F.greatest(F.coalesce("__now", F.lit(0)) - F.col("__then"), F.lit(0)).cast("double"))
    return out.withColumns({"team_games_missed": missed, "b2b": F.coalesce("b2b", F.lit(0.0))}).drop("__now", "__then", "last_date")


def _rank_share(by: list[str], value: str) -> Column:
    """operators.ranking.rank_share in one sort: the mean of the first and the last rank of a tie."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(F.col(value).isNotNull(), F.when(n > 1, ((F.rank().over(w) + last) / 2 - 1) / (n - 1)).otherwise(0.0))


def lineup_ranks(df: DataFrame) -> DataFrame:
    """df (with es_toi_l10, toi_mean_l10, pp_toi_l10) with the player's ranks among those dressed for the game."""
    by = ["game_id", "team", "pos_group"]
    ranked = F.rank().over(Window.partitionBy("game_id", "team").orderBy(F.col("pp_toi_l10").desc_nulls_last())).cast("double")
    return df.withColumns({"es_toi_rank_pct": _rank_share(by, "es_toi_l10"), "toi_rank_pct": _rank_share(by, "toi_mean_l10"), "pp_rank": F.when(F.col("pp_toi_l10").isNotNull(), ranked)})


def player_features(skaters: DataFrame, games: DataFrame, attempts: DataFrame, team_games: DataFrame, shots: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """One row for each skater and game that he played, with what is known of him before it. See played_rows for the inputs; team_games: game_id, team, sog; ratings: game_id, home_elo, away_elo before the game."""
    df = step(played_rows(skaters, games, attempts, shots).withColumns(_lineup_minutes(_own_order())), "played")
    levels, minutes, asked = small_step(league_levels(df), "league-levels"), small_step(team_minutes(df), "team-minutes"), df.select("team", "last_date")
    df = step(lineup_ranks(dealt(df, "game_id", "team")).drop("es_toi_l10", "toi_mean_l10", "pp_toi_l10", "last_date"), "played-ranked")
    # the last shuffle; from here on rows only get wider where they are
    df = _meets(dealt(df, "player_id"), levels, ["season", "pos_group", "date"])
    df = _meets(df, minutes.select("game_id", "team", "team_pp", "team_pk"), ["game_id", "team"])
    df = with_schedule(decayed_level(own_history(df)), games, asked)
    df = df.join(minutes.select("game_id", "team", "team_pp_l10"), ["game_id", "team"], "left").join(minutes.select("game_id", F.col("team").alias("opp"), F.col("team_pk_l10").alias("opp_pk_l10")), ["game_id", "opp"], "left")
    tf = small_step(team_shots(step(team_games.select("game_id", "team", "sog"), "team-games"), games), "team-shots")
    own = tf.select("game_id", "team", *[f"team_sf_l{n}_rel" for n in TEAM_ROWS])
    opp = tf.select("game_id", F.col("team").alias("opp"), *[F.col(f"team_sa_l{n}_rel").alias(f"opp_sa_l{n}_rel") for n in TEAM_ROWS])
    df = df.join(own, ["game_id", "team"], "left").join(opp, ["game_id", "opp"], "left")
    if ratings is None:
        return df.withColumn("elo_diff", F.lit(None).cast("double"))
    gap = F.col("home_elo") - F.col("away_elo")
    ratings = small_step(ratings.select("game_id", "home_elo", "away_elo"), "ratings")
    return df.join(ratings, "game_id", "left").withColumn("elo_diff", F.when(F.col("is_home") == 1, gap).otherwise(-gap)).drop("home_elo", "away_elo")


XG_FEATURES = ("ixg60_l10_rel", "ixg60_l20_rel", "ixg60_season_rel", "xg_per_att_l20_rel", "opp_xga_l20_rel")


def player_xg_features(df: DataFrame, shots: DataFrame, xg: str = "xg") -> DataFrame:
    """df (rows of player_features) with XG_FEATURES: chances by expected goals, each against the league of the year before. shots: game_id, shooter_id, team and the expected goals of each. A game without shots is unknown."""
    covered = small_step(shots.select("game_id").distinct(), "shots-covered").withColumn("__covered", F.lit(1.0))
    own = shots.filter("shooter_id IS NOT NULL").select("game_id", F.col("shooter_id").alias("player_id"), F.col(xg).alias("__xg")).repartition("player_id").groupBy("game_id", "player_id").agg(F.sum("__xg").alias("__xg"))
    known = F.col("__covered").isNotNull()
    out = df.join(own, ["game_id", "player_id"], "left").join(covered, "game_id", "left")
    out = out.withColumns({"__x": F.when(known, F.coalesce("__xg", F.lit(0.0))).otherwise(0.0), "__t": F.when(known, F.col("toi")).otherwise(0.0), "__a": F.when(known, F.coalesce("att", F.lit(0.0))).otherwise(0.0)})
    out = step(out.drop("__xg", "__covered"), "played-xg")
    by = step(out.groupBy("pos_group", "date").agg(*[F.sum(c).alias(c) for c in ("__x", "__t", "__a")]), "xg-days")
    by = day_sums(by, ["pos_group"], "date", ["__x", "__t"], {"pos": (-LEAGUE_DAYS, -1)})
    by = day_sums(by.withColumn("__all", F.lit(0)), ["__all"], "date", ["__x", "__a"], {"all": (-LEAGUE_DAYS, -1)})
    rel = per60(F.col("__x_sum_pos"), F.col("__t_sum_pos"))
    quality = ratio(F.col("__x_sum_all"), F.col("__a_sum_all"))
    levels = small_step(by.select("pos_group", "date", rel.alias("__rel"), quality.alias("__quality")), "xg-levels")
    # what the opponent allowed: the other side's expected goals of each of its games
    by_side = shots.groupBy("game_id", F.col("team").alias("opp")).agg(F.sum(xg).alias("xga"))
    tg = step(out.select("game_id", "date", "team", "opp").distinct(), "xg-sides").join(by_side, ["game_id", "opp"], "left").join(covered, "game_id", "left")
    tg = tg.withColumns({"__k": F.coalesce("__covered", F.lit(0.0)), "__v": F.when(F.col("__covered").isNotNull(), F.coalesce("xga", F.lit(0.0))).otherwise(0.0), "__all": F.lit(0)})
    tg = day_sums(step(tg, "xg-allowed"), ["__all"], "date", ["__v", "__k"], {"lg": (-LEAGUE_DAYS, -1)})
    w = Window.partitionBy("team").orderBy("date", "game_id").rowsBetween(-20, -1)
    allowed = F.try_divide(ratio(F.sum("__v").over(w), F.sum("__k").over(w)), ratio(F.col("__v_sum_lg"), F.col("__k_sum_lg")))
    tg = small_step(tg.select("game_id", F.col("team").alias("opp"), allowed.alias("opp_xga_l20_rel")), "xg-opponents")
    # the last shuffle
    out = _meets(dealt(out, "player_id"), levels, ["pos_group", "date"])
    order = _own_order()
    season = Window.partitionBy("player_id", "season").orderBy("date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    s = lambda c, n: F.sum(c).over(order.rowsBetween(-n, -1))
    out = out.withColumns({f"ixg60_l{n}_rel": F.try_divide(per60(s("__x", n), s("__t", n)), F.col("__rel")) for n in (10, 20)} | {
        "ixg60_season_rel": F.try_divide(per60(F.sum("__x").over(season), F.sum("__t").over(season)), F.col("__rel")), "xg_per_att_l20_rel": F.try_divide(ratio(s("__x", 20), s("__a", 20)), F.col("__quality")),
    })
    return out.join(tg, ["game_id", "opp"], "left").select(*df.columns, *XG_FEATURES)


def gsax60_prior(appearances: DataFrame, shots: DataFrame, xg: str = "xg") -> DataFrame:
    """season, gsax60: goals saved above expected per hour, over appearances (game_id, goalie_id, season, toi) with their shots (game_id, goalie_id, goal).

    An appearance's time counts once for each shot it faced, and once without any: the rate is one of joined rows. NULL without shots.
    """
    faced = shots.groupBy("game_id", "goalie_id").agg(F.sum(F.col(xg) - F.col("goal").cast("double")).alias("saved"), F.count(F.lit(1)).alias("n"))
    rows = appearances.filter("toi > 0").join(faced, ["game_id", "goalie_id"], "left")
    return rows.groupBy("season").agg((3600 * F.sum("saved") / F.sum(F.col("toi") * F.coalesce("n", F.lit(1)))).alias("gsax60"))
