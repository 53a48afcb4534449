"""Stored shifts put right: rows of other teams and repeated ones go, and every game is judged by its size and against the box score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A full game has so many shifts and players, and a skater's shifts add up to his ice time within so many seconds.
LEAST_SHIFTS, LEAST_PLAYERS, TOLERANCE = 400, 30, 60


def cleaned(shifts: DataFrame, games: DataFrame) -> DataFrame:
    """shifts with fate: `kept`, `wrong_team` for rows of neither side (games: game_id, home, away; unknown sides allow all), `repeated` for all but the lowest shift_id of a player, period and start."""
    rows = shifts.join(games.select("game_id", "home", "away"), "game_id", "left")
    allowed = F.array_compact(F.array("home", "away"))
    foreign = (F.size(allowed) > 0) & ~F.coalesce(F.array_contains(allowed, F.col("team")), F.lit(False))
    rows = rows.withColumn("__foreign", foreign)
    first = F.row_number().over(Window.partitionBy("game_id", "__foreign", "player_id", "period", "start").orderBy(*[F.col(c).asc_nulls_last() for c in ("shift_id", "end", "duration")]))
    return rows.withColumn("fate", F.when(F.col("__foreign"), "wrong_team").when(first > 1, "repeated").otherwise("kept")).drop("__foreign", "home", "away")


def _by_game(df: DataFrame) -> DataFrame:
    """df dealt by game over all shuffle partitions. Left to itself Spark joins small parts into a few of the size of its target, and a task's sorts hold several times that."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "game_id")


def judged(shifts: DataFrame, games: DataFrame, ice_time: DataFrame, least_shifts: int = LEAST_SHIFTS, least_players: int = LEAST_PLAYERS, tolerance: int = TOLERANCE) -> DataFrame:
    """game_id, status, n_shifts, n_players, wrong_team, repeated, n_off, worst_player, worst_shifts, worst_ice for every game of games.

    empty has no rows, partial too few; a full one is suspect when skaters' shifts are further than the tolerance from their ice time
    (game_id, player_id, toi_seconds over 0), or there is none to compare with; else ok. Worst is the largest gap, of equal ones the
    highest player, and n_off counts them; both are for full games only.
    """
    fate, kept = F.col("fate"), F.col("fate") == "kept"
    rows = cleaned(_by_game(shifts), games).select("game_id", "player_id", "fate", "duration", F.lit(None).cast(ice_time.schema["toi_seconds"].dataType).alias("toi_seconds"))
    box = ice_time.filter("toi_seconds > 0").select("game_id", "player_id", F.lit(None).cast("string").alias("fate"), F.lit(None).cast(shifts.schema["duration"].dataType).alias("duration"), "toi_seconds")
    # a player's shifts and ice time are added up side by side, then those of a game, where they lie
    players = _by_game(rows.unionByName(box)).groupBy("game_id", "player_id").agg(
        F.count_if(kept).alias("kept"), F.count_if(fate == "wrong_team").alias("wrong"), F.count_if(fate == "repeated").alias("again"), F.coalesce(F.sum(F.when(kept, F.col("duration"))), F.lit(0)).alias("seconds"), F.collect_list("toi_seconds").alias("boxes")
    )
    # rows without a player have no ice time to meet
    seconds = F.when(F.col("player_id").isNull(), F.lit(0)).otherwise(F.col("seconds"))
    gaps = F.transform("boxes", lambda t: F.struct(F.abs(F.col("seconds") - t).alias("gap"), "player_id", "seconds", t.alias("toi_seconds")))
    off = F.filter("gaps", lambda g: g["gap"] > tolerance)
    by = players.withColumn("seconds", seconds).withColumn("gaps", gaps).withColumn("off", off).groupBy("game_id").agg(
        F.sum("kept").alias("n_shifts"), F.count_if((F.col("kept") > 0) & F.col("player_id").isNotNull()).alias("n_players"), F.sum("wrong").alias("wrong_team"), F.sum("again").alias("repeated"),
        F.when(F.max(F.size("boxes")) > 0, F.sum(F.size("off")).cast("long")).alias("n_off"), F.max(F.array_max("off")).alias("worst"),
    )
    out = games.select("game_id").join(by, "game_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    full = (zero("n_shifts") >= least_shifts) & (zero("n_players") >= least_players)
    status = F.when(zero("n_shifts") == 0, "empty").when(~full, "partial").when(F.col("n_off").isNull() | (F.col("n_off") > 0), "suspect").otherwise("ok")
    of_full = lambda c: F.when(full, F.col(c))
    return out.select(
        "game_id", status.alias("status"), *[zero(c).alias(c) for c in ("n_shifts", "n_players", "wrong_team", "repeated")], of_full("n_off").alias("n_off"), of_full("worst.player_id").alias("worst_player"), of_full("worst.seconds").alias("worst_shifts"), of_full("worst.toi_seconds").alias("worst_ice")
    )


def rechecked(shifts: DataFrame, games: DataFrame, ice_time: DataFrame, fetches: DataFrame, **limits: int) -> tuple[DataFrame, DataFrame]:
    """The shifts that stay, and fetches (game_id, status, ...) with the status they should have; only games fetched as ok, partial or suspect are looked at, others keep rows and status."""
    again = fetches.filter(F.col("status").isin("ok", "partial", "suspect")).select("game_id")
    looked_at = games.join(again, "game_id", "left_semi")
    mine = shifts.join(again, "game_id", "left_semi")
    kept = cleaned(mine, looked_at).filter("fate = 'kept'").drop("fate").unionByName(shifts.join(again, "game_id", "left_anti"))
    new = judged(mine, looked_at, ice_time, **limits).select("game_id", F.col("status").alias("__new"), "n_shifts", "n_players")
    other = [c for c in fetches.columns if c not in ("status", "n_shifts", "n_players")]
    out = fetches.select(*other, "status").join(new, "game_id", "left")
    return kept, out.select(*other, F.coalesce("__new", "status").alias("status"), (F.col("__new") != F.col("status")).alias("changed"), "n_shifts", "n_players")


def coverage(games: DataFrame, fetches: DataFrame, shifts: DataFrame, ice_time: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """For each season of finished games (game_id, season, home, away): how they were fetched (fetches: game_id, status, source, n_shifts), players of the box score without a shift, gaps between shifts and ice time, repeated rows and rows of other teams.

    Everything is counted by game first, then by season; gaps are of skaters with shifts in games fetched as ok (ice_time:
    game_id, player_id, toi_seconds, skater).
    """
    played = ice_time.filter("toi_seconds > 0")
    fine = fetches.filter("status = 'ok'").select("game_id")
    summed = shifts.groupBy("game_id", "player_id").agg(F.sum("duration").alias("secs"))
    box = played.select("game_id", "player_id", "toi_seconds", "skater").join(fine, "game_id").join(summed.withColumn("__shifted", F.lit(True)), ["game_id", "player_id"], "left")
    missing = box.groupBy("game_id").agg(F.countDistinct(F.when(F.col("__shifted").isNull(), F.col("player_id"))).alias("missing"))
    gap = F.abs(F.col("secs") - F.col("toi_seconds"))
    gaps = box.filter("skater AND secs IS NOT NULL").join(games.select("game_id", "season"), "game_id").groupBy("season").agg(F.median(gap).alias("median_gap"), F.count(F.lit(1)).alias("checked"), F.count_if(gap > 5).alias("over_5"), F.count_if(gap > tolerance).alias("over_tolerance"))
    repeated = shifts.groupBy("game_id", "player_id", "period", "start").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("game_id").agg(F.sum("n").alias("repeated"))
    g = games.select("game_id", "season", "home", "away")
    foreign = shifts.select("game_id", "team").join(g, "game_id").filter(~F.col("team").eqNullSafe(F.col("home")) & ~F.col("team").eqNullSafe(F.col("away"))).groupBy("game_id").agg(F.count(F.lit(1)).alias("foreign"))
    rows = g.join(fetches.select("game_id", "status", "source", "n_shifts"), "game_id", "left").join(missing, "game_id", "left").join(repeated, "game_id", "left").join(foreign, "game_id", "left")
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    by = rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("finished"), of("ok"), F.count_if((F.col("status") == "ok") & (F.col("source") == "html")).alias("ok_from_html"), of("suspect"), of("partial"), of("empty"), of("error"), F.count_if(F.col("status").isNull()).alias("not_fetched"),
        total("n_shifts", "shifts"), total("missing", "players_without_shifts"), total("repeated", "repeated_rows"), total("foreign", "wrong_team_rows"),
    )
    return by.join(gaps, "season", "left")
