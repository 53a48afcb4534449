"""Feature plans: the operators put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.functions.calendar import haversine_km, utc_offset_hours
from foretime.functions.guards import both_or_neither, clip, stage_of
from foretime.functions.text import strength
from foretime.operators.pit import prior_ratios, shrunk
from foretime.operators.reshape import differences, pair_sides, sides, vector

WINDOWS = [5, 10, 20, 40, 82]

#: name -> (numerator, denominator, scale) of sums over a window.
TEAM_RATIOS = {
    "gf_per60": ("gf", "toi", 3600.0),
    "ga_per60": ("ga", "toi", 3600.0),
    "xgf_per60": ("xgf", "toi", 3600.0),
    "xga_per60": ("xga", "toi", 3600.0),
    "sh_pct": ("gf", "sog_for", 1.0),
    "pp_pct": ("pp_goals", "pp_opps", 1.0),
    "fow_pct": ("fow", "fo_total", 1.0),
    "pim_per60": ("pim", "toi", 3600.0),
}


def team_rolling(base: DataFrame, windows: list[int] = WINDOWS, ratios: dict = TEAM_RATIOS, keys: tuple[str, ...] = ("team", "season")) -> DataFrame:
    """base (a row for each team and game) with ratios of sums over the games before, within the season."""
    return prior_ratios(base, list(keys), ["date", "game_id"], ratios, windows)


#: Shares and rates of a side, of sums over a window.
TEAM_RATES = ("gf_per60", "ga_per60", "xgf_pct", "cf_pct", "ff_pct", "sh_pct", "sv_pct", "pdo", "pp_pct", "pk_pct", "pp_xgf_per60", "pk_xga_per60", "fow_pct", "pim_per60")
_SUMS = ("gf", "ga", "xgf", "xga", "cf", "ca", "ff", "fa", "toi", "sog_for", "sog_against", "pp_goals", "pp_opps", "ppga", "opp_pp_opps", "pp_xgf", "pk_xga", "pp_toi", "sh_toi", "fow", "fo_total", "pim")


def team_base(raw: DataFrame) -> DataFrame:
    """A row for each side and game with what is derived from its counts: attempts with blocked ones, seconds of play (0 is unknown) and of special teams by player, and shares' two sides both known or both unknown."""
    out = raw.withColumns({
        "cf": F.col("ff") + F.col("blocks_opp"), "ca": F.col("fa") + F.col("blocks_own"), "toi": F.when(F.col("toi") > 0, F.col("toi")), "pp_toi": F.col("pp_toi_raw") / 5, "sh_toi": F.col("sh_toi_raw") / 4,
    })
    return both_or_neither(out, [("xgf", "xga"), ("cf", "ca"), ("ff", "fa")])


def team_rates(base: DataFrame, windows: list[int] = WINDOWS, keys: tuple[str, ...] = ("team", "season")) -> DataFrame:
    """base with games_{w} and TEAM_RATES over the w games before, within the season. Sums skip unknown games; a rate without a base is NULL; rates of special teams are at most 99, which something in no time is too. All windows share one sort."""
    sort, out = Window.partitionBy(*keys).orderBy("date", "game_id"), {}
    for n in windows:
        w = sort.rowsBetween(-n, -1)
        s = {c: F.sum(c).over(w).cast("double") for c in _SUMS}
        share = lambda a, b: F.try_divide(s[a], s[a] + s[b])  # noqa: E731, B023
        per_hour = lambda a, b="toi": F.try_divide(3600 * s[a], s[b])  # noqa: E731, B023
        sh, sv = F.try_divide(s["gf"], s["sog_for"]), 1 - F.try_divide(s["ga"], s["sog_against"])
        rates = (per_hour("gf"), per_hour("ga"), share("xgf", "xga"), share("cf", "ca"), share("ff", "fa"), sh, sv, sh + sv, F.try_divide(s["pp_goals"], s["pp_opps"]), 1 - F.try_divide(s["ppga"], s["opp_pp_opps"]))
        capped = lambda a, b: F.when(s[b] > 0, F.least(3600 * s[a] / s[b], F.lit(99.0))).when(s[a] > 0, F.lit(99.0))  # noqa: E731, B023
        rates += (capped("pp_xgf", "pp_toi"), capped("pk_xga", "sh_toi"), F.try_divide(s["fow"], s["fo_total"]), per_hour("pim"))
        out |= {f"games_{n}": F.count(F.lit(1)).over(w).cast("int")} | {f"{name}_{n}": r for name, r in zip(TEAM_RATES, rates)}
    return base.withColumns(out)


def goalie_rolling(base: DataFrame, priors: DataFrame, k: float = 66.0, windows: list[int] = WINDOWS) -> DataFrame:
    """Save share over the appearances before, shrunk to the league's of the season before: sv_{w} and shrunk_sv_{w}."""
    out = prior_ratios(base, ["goalie_id", "season"], ["date", "game_id"], {"sv": ("saves", "shots", 1.0)}, windows)
    out = out.join(F.broadcast(priors.select("season", "league_sv")), "season", "left").fillna({"league_sv": 0.905})  # a row for each season
    return out.withColumns({f"shrunk_sv_{w}": shrunk(F.col(f"sv_{w}"), F.col(f"rows_{w}"), k, F.col("league_sv")) for w in windows})


def schedule_features(games: DataFrame) -> DataFrame:
    """game_id and, for home and away, game_num, stage, rest, b2b, travel_km, tz_shift.

    games: game_id, season, date, home, away, lat, lon, zone of the venue. One shuffle by side and season, one back by game.
    """
    s = sides(games, ["game_id", "season", "date", "lat", "lon", "zone"], {"team": "home"}, {"team": "away"})
    w = Window.partitionBy("team", "season").orderBy("date", "game_id")
    prev = lambda c: F.lag(c).over(w)
    days = F.datediff("date", prev("date"))
    s = s.withColumns({
        "game_num": F.row_number().over(w),
        "rest": days - 1,
        "travel_km": F.round(haversine_km(prev("lat"), prev("lon"), F.col("lat"), F.col("lon")), 1),
        "tz_shift": F.coalesce(F.round(utc_offset_hours(F.col("date"), F.col("zone")) - utc_offset_hours(prev("date"), prev("zone"))), F.lit(0.0)),
    })
    s = s.withColumns({"b2b": F.coalesce(F.col("rest") == 0, F.lit(False)), "stage": stage_of(F.col("game_num"))})
    return pair_sides(s, ["game_id"], "is_home", ["game_num", "stage", "rest", "b2b", "travel_km", "tz_shift"])


def starters(appearances: DataFrame) -> DataFrame:
    """One goalie for each team and game: the one marked, else the longest on the ice, of equal ones the lowest id; one aggregation."""
    order = F.struct(F.when(F.col("is_starter"), 0).otherwise(1), -F.coalesce("toi", F.lit(0)), "goalie_id")
    rest = [c for c in appearances.columns if c not in ("team", "game_id")]
    return appearances.groupBy("team", "game_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("team", "game_id", "r.*")


def game_vectors(games: DataFrame, team: DataFrame, names: list[str], market: DataFrame | None = None) -> DataFrame:
    """game_id, names, vector: home minus away of each name, unknown as 0, then the fair price (0.5 without) and whether there is one."""
    side = lambda p: team.select("game_id", F.col("team").alias(p), *[F.col(n).alias(f"{p}_{n}") for n in names])
    out = differences(games.join(side("home"), ["game_id", "home"], "left").join(side("away"), ["game_id", "away"], "left"), names)
    if market is None:
        out = out.withColumns({"fair_home": F.lit(0.5), "priced": F.lit(0.0)})
    else:
        out = out.join(market.select("game_id", "fair_home"), "game_id", "left").withColumn("priced", F.col("fair_home").isNotNull().cast("double")).fillna({"fair_home": 0.5})
    columns = [f"{n}_diff" for n in names] + ["fair_home", "priced"]
    return out.select("game_id", F.array(*[F.lit(c) for c in columns]).alias("names"), vector(columns).alias("vector"))


def recent_share(df: DataFrame, keys: list[str], order: list[str], flag: str, n: int, least: int) -> Column:
    """The share of the n rows before with flag; NULL under least rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return F.when(F.count(flag).over(w) >= least, F.avg(F.col(flag).cast("double")).over(w))


def goalie_rates(base: DataFrame, windows: list[int] = WINDOWS, k: float = 66.0, league_sv: float | Column = 0.905, league_gsax: float | Column = 0.0, keys: tuple[str, ...] = ("goalie_id", "season")) -> DataFrame:
    """base (a row for each appearance) with n_{w}, credibility z_{w}, rates over the w appearances before and their blends with the league's; without any before, the blend is the league's rate."""
    sort, out = Window.partitionBy(*keys).orderBy("date", "game_id"), {}
    league_sv, league_gsax = (x if isinstance(x, Column) else F.lit(x) for x in (league_sv, league_gsax))
    sums = ("saves", "shots", "gsax", "toi", "hd_goals", "hd_att", "fen_goals", "fen_att", "xga")
    for n in windows:
        w = sort.rowsBetween(-n, -1)
        s = {c: F.sum(c).over(w).cast("double") for c in sums}
        count = F.count(F.lit(1)).over(w).cast("int")
        z = count / (count + F.lit(k))
        hourly = lambda c: F.when(s["toi"] > 0, 3600 * s[c] / s["toi"])  # noqa: E731, B023
        sv, gsax = F.try_divide(s["saves"], s["shots"]), clip(hourly("gsax"), -99.0, 99.0)
        blend = lambda raw, league: F.when(count > 0, z * raw + (1 - z) * league).otherwise(league)  # noqa: E731, B023
        out |= {
            f"n_{n}": count, f"z_{n}": z, f"sv_{n}": sv, f"gsax60_{n}": gsax, f"hd_sv_{n}": 1 - F.try_divide(s["hd_goals"], s["hd_att"]), f"fenwick_sv_{n}": 1 - F.try_divide(s["fen_goals"], s["fen_att"]),
            f"xga60_{n}": F.when(s["toi"] > 0, F.least(hourly("xga"), F.lit(99.0))), f"shrunk_sv_{n}": blend(sv, league_sv), f"shrunk_gsax_{n}": blend(gsax, league_gsax),
        }
    return base.withColumns(out)


def shot_context(shots: DataFrame, cap: float = 600.0) -> DataFrame:
    """shots (game_id, shot_id, t, period, team, home_team, x, y, angle, distance, goal, strength, score) with what a model of goals may know: the shot itself, the state of play, and the shot before it in the game.

    Distance moved and rate of turning count within a period only; the game's first shot has no shot before it.
    """
    w = Window.partitionBy("game_id").orderBy("t", "shot_id")
    before = lambda c: F.lag(c).over(w)
    same, secs = before("period") == F.col("period"), clip(F.col("t") - before("t"), 0.0, cap)
    home, men = F.col("team") == F.col("home_team"), strength(F.col("strength"))
    out = shots.withColumns({
        "secs_since_prev": secs, "prev_same_team": (before("team") == F.col("team")).cast("double"), "prev_dist_moved": F.when(same, F.hypot(F.col("x") - before("x"), F.col("y") - before("y"))),
        "prev_angle_rate": F.when(same, F.abs(F.col("angle") - before("angle")) / F.when(secs > 1, secs).otherwise(F.lit(1.0))), "prev_was_goal": before("goal").cast("double"), "prev_distance": before("distance"),
    })
    return out.withColumns({
        "x_abs": F.abs("x"), "y_abs": F.abs("y"), "shooter_skaters": men["own"], "defender_skaters": men["other"], "empty_net": (men["other"] >= 6).cast("double"), "period_seconds": clip(F.col("t") - 1200.0 * (F.col("period") - 1), 0.0, 1200.0),
        "overtime": (F.col("period") >= 4).cast("double"), "period": F.least("period", F.lit(4)), "score_diff": clip(F.when(home, F.col("score")).otherwise(-F.col("score")), -4, 4), "shooter_home": home.cast("double"),
    })


def expected_sums(shots: DataFrame, by: list[str], xg: str = "xg", dangerous: float = 0.2) -> DataFrame:
    """For each key: expected goals of all shots and of those on the power play (NULL without any), and how many on target are dangerous and went in."""
    on_target, threat = F.col("event").isin("SHOT", "GOAL"), F.col(xg) >= dangerous
    return shots.groupBy(*by).agg(
        F.sum(xg).alias("xg"), F.sum(F.when(F.col("strength").isin("5v4", "5v3", "4v3"), F.col(xg))).alias("pp_xg"), F.count_if(on_target & threat).alias("hd_att"), F.count_if(on_target & threat & F.col("goal")).alias("hd_goals")
    )
