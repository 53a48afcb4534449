"""Games that haven't been played yet go through the plans that make the stored rows, so live and stored vectors can't differ.

An unplayed game is a row without statistics behind the history of its sides: the windows of the feature plans look at
earlier rows only, so its features are those that the stored row will have once it is played.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.functions.prices import fair
from foretime.operators.markets import in_play
from foretime.operators.reshape import sides, vector
from foretime.plans import boosting
from foretime.plans.features import TEAM_RATES, WINDOWS, goalie_rates, team_rates

#: What a goalie gives to a vector: shrunk rates and how far they are trusted.
GOALIE_RATES = ("shrunk_sv", "shrunk_gsax", "z")
#: Starts of a team that a projection of its next starter counts.
RECENT_GAMES = 10


def with_unplayed(history: DataFrame, slate: DataFrame) -> DataFrame:
    """history of the slate's seasons before its date, and the slate's rows, marked by __new, whose other columns are unknown. A slate has one date in a season."""
    dates = slate.groupBy("season").agg(F.min("date").alias("__first"), F.max("date").alias("__last"))
    on = F.when(F.col("__first") == F.col("__last"), F.col("__first")).otherwise(F.raise_error(F.lit("a slate has one date in a season")).cast("date"))
    # a row for each season
    past = history.join(F.broadcast(dates.select("season", on.alias("__on"))), "season").filter(F.col("date") < F.col("__on")).drop("__on")
    return past.withColumn("__new", F.lit(False)).unionByName(slate.withColumn("__new", F.lit(True)), allowMissingColumns=True)


def team_asof(base: DataFrame, slate: DataFrame, windows: list[int] = WINDOWS) -> DataFrame:
    """game_id, team, games_{w} and rates of both sides of the slate (game_id, season, date, home, away)."""
    rows = sides(slate, ["game_id", "season", "date"], {"team": "home"}, {"team": "away"}).drop("is_home")
    names = [f"{n}_{w}" for w in windows for n in ("games", *TEAM_RATES)]
    return team_rates(with_unplayed(base, rows), windows).filter("__new").select("game_id", "team", *names)


def league_priors(base: DataFrame, next_season: Column, fallback: tuple[float, float] = (0.905, 0.0)) -> DataFrame:
    """season, league_sv, league_gsax: the league's rates of a season, for the season after it. next_season names that one."""
    by = base.filter("toi > 0").groupBy(next_season.alias("season")).agg(F.try_divide(F.sum("saves"), F.sum("shots")).cast("double").alias("league_sv"), F.try_divide(3600 * F.sum("gsax"), F.sum("toi")).cast("double").alias("league_gsax"))
    return by.select("season", F.coalesce("league_sv", F.lit(fallback[0])).alias("league_sv"), F.coalesce("league_gsax", F.lit(fallback[1])).alias("league_gsax"))


def goalie_rates_by_season(base: DataFrame, priors: DataFrame, windows: list[int] = WINDOWS, k: float = 66.0, fallback: tuple[float, float] = (0.905, 0.0)) -> DataFrame:
    """Rates shrunk to the league's of the season before; to the fallback where there is none."""
    known = base.join(F.broadcast(priors), "season", "left")  # a row for each season
    known = known.withColumns({"league_sv": F.coalesce("league_sv", F.lit(fallback[0])), "league_gsax": F.coalesce("league_gsax", F.lit(fallback[1]))})
    return goalie_rates(known, windows, k, F.col("league_sv"), F.col("league_gsax")).drop("league_sv", "league_gsax")


def goalie_asof(base: DataFrame, starters: DataFrame, priors: DataFrame, windows: list[int] = WINDOWS, k: float = 66.0) -> DataFrame:
    """game_id, goalie_id and rates for the starters (game_id, season, date, goalie_id) whose goalie is known."""
    rows = starters.filter("goalie_id IS NOT NULL").select("game_id", "season", "date", "goalie_id")
    names = [f"{n}_{w}" for w in windows for n in GOALIE_RATES]
    return goalie_rates_by_season(with_unplayed(base, rows), priors, windows, k).filter("__new").select("game_id", "goalie_id", *names)


def project_starters(starts: DataFrame, slate: DataFrame, announced: DataFrame | None = None, recent: int = RECENT_GAMES) -> DataFrame:
    """game_id, season, date, team, goalie_id, fallback for both sides of the slate.

    An announced goalie (team, date, goalie_id, confirmed) comes first, and is no fallback once confirmed. Else the one with the
    most starts (team, season, date, game_id, goalie_id) in the team's last games of the season, of equal ones the last to start;
    unknown when the team has none.
    """
    rows = sides(slate, ["game_id", "season", "date"], {"team": "home"}, {"team": "away"}).drop("is_home")
    dates = rows.groupBy("season").agg(F.max("date").alias("__on"))
    past = starts.join(F.broadcast(dates), "season").filter(F.col("date") < F.col("__on"))  # a row for each season
    ranked = past.withColumn("__rank", F.dense_rank().over(Window.partitionBy("team", "season").orderBy(F.desc("date"), F.desc("game_id"))))
    by = ranked.groupBy("team", "season", "goalie_id").agg(F.count_if(F.col("__rank") <= recent).alias("n"), F.max("date").alias("last"))
    picks = by.groupBy("team", "season").agg(F.max_by("goalie_id", F.struct("n", "last", -F.col("goalie_id"))).alias("pick"))
    out = rows.join(picks, ["team", "season"], "left")
    if announced is None:
        return out.select("game_id", "season", "date", "team", F.col("pick").alias("goalie_id"), F.lit(1).alias("fallback"))
    out = out.join(announced.filter("goalie_id IS NOT NULL").select("team", "date", F.col("goalie_id").alias("named"), "confirmed"), ["team", "date"], "left")
    return out.select("game_id", "season", "date", "team", F.coalesce("named", "pick").alias("goalie_id"), F.when(F.col("named").isNotNull() & F.col("confirmed"), 0).otherwise(1).alias("fallback"))


def market_of_lines(lines: DataFrame) -> DataFrame:
    """game_id, fair_home of two-sided lines (game_id, home_ml, away_ml, over_under) that could be from before the start."""
    known = lines.filter(F.col("home_ml").isNotNull() & F.col("away_ml").isNotNull() & ~in_play(F.col("home_ml"), F.col("away_ml"), F.col("over_under")))
    return known.select("game_id", fair(F.col("home_ml"), F.col("away_ml")).alias("fair_home"))


#: Names of what else a vector knows of a game.
CONTEXT = ("elo_diff", "rest_diff", "b2b_home", "b2b_away", "travel_diff", "tz_home", "tz_away", "game_num_diff", "stage_early", "stage_late")


def feature_names(windows: list[int] = WINDOWS) -> list[str]:
    """All names of a vector, in its order."""
    out = [n for w in windows for n in (*(f"{s}_diff_w{w}" for s in TEAM_RATES), f"gp_home_w{w}", f"gp_away_w{w}")]
    out += [f"goalie_{s}_diff_w{w}" for w in windows for s in GOALIE_RATES]
    return [*out, "starter_fallback_home", "starter_fallback_away", *CONTEXT, "market_prob", "market_available"]


def _context() -> dict[str, Column]:
    diff = lambda n: F.coalesce(F.col(f"home_{n}").cast("double") - F.col(f"away_{n}"), F.lit(0.0))
    own = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    stage = lambda s: F.coalesce(F.col("stage") == s, F.lit(False)).cast("double")
    made = (diff("elo"), diff("rest"), own("home_b2b"), own("away_b2b"), diff("travel_km"), own("home_tz_shift"), own("away_tz_shift"), diff("game_num"), stage("EARLY"), stage("LATE"))
    return dict(zip(CONTEXT, made))


def assemble(games: DataFrame, team: DataFrame, starters: DataFrame, goalie: DataFrame, market: DataFrame | None = None, windows: list[int] = WINDOWS) -> DataFrame:
    """A row for each game with every name of feature_names, game_id, season, date, home_win, home_goals, away_goals and both goalies.

    games: game_id, season, date, home, away, home_score, away_score and, for both sides, elo, rest, b2b, travel_km, tz_shift, game_num,
    and stage. A side without rates, and a game without a line, count as no difference and as no price. The sides of a game are put
    together by one aggregation.
    """
    names = [f"{n}_{w}" for w in windows for n in ("games", *TEAM_RATES)]
    goalie_names = [f"{n}_{w}" for w in windows for n in GOALIE_RATES]
    known = starters.select("game_id", "team", "goalie_id", "fallback").join(goalie.select("game_id", "goalie_id", *[F.col(n).alias(f"goalie_{n}") for n in goalie_names]), ["game_id", "goalie_id"], "left")
    own = team.select("game_id", "team", *names).join(known, ["game_id", "team"], "full")
    each = sides(games, ["game_id"], {"team": "home"}, {"team": "away"}).join(own, ["game_id", "team"], "left")
    columns = ["goalie_id", "fallback", *names, *[f"goalie_{n}" for n in goalie_names]]
    side = lambda at: F.max(F.when(F.col("is_home") == at, F.struct(*columns)))
    both = each.groupBy("game_id").agg(side(True).alias("h"), side(False).alias("a"))
    out = games.join(both, "game_id")
    if market is not None:
        out = out.join(market.select("game_id", F.col("fair_home").alias("__fair")), "game_id", "left")
    else:
        out = out.withColumn("__fair", F.lit(None).cast("double"))
    diff = lambda n: F.coalesce(F.col(f"h.{n}").cast("double") - F.col(f"a.{n}"), F.lit(0.0))
    made: dict[str, Column] = {}
    for w in windows:
        made |= {f"{s}_diff_w{w}": diff(f"{s}_{w}") for s in TEAM_RATES}
        made |= {f"gp_{p}_w{w}": F.coalesce(F.col(f"{q}.games_{w}").cast("double"), F.lit(0.0)) for p, q in (("home", "h"), ("away", "a"))}
        made |= {f"goalie_{s}_diff_w{w}": diff(f"goalie_{s}_{w}") for s in GOALIE_RATES}
    made |= {f"starter_fallback_{p}": F.coalesce(F.col(f"{q}.fallback").cast("double"), F.lit(1.0)) for p, q in (("home", "h"), ("away", "a"))}
    made |= _context() | {"market_prob": F.coalesce("__fair", F.lit(0.5)), "market_available": F.col("__fair").isNotNull().cast("double")}
    label = (F.col("home_score") > F.col("away_score")).alias("home_win")
    return out.select("game_id", "season", "date", label, F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"), F.col("h.goalie_id").alias("home_goalie"), F.col("a.goalie_id").alias("away_goalie"), *[made[n].alias(n) for n in feature_names(windows)])


def finite(vectors: DataFrame, names: list[str]) -> DataFrame:
    """vectors, or an error where an entry isn't a finite number."""
    checked = reduce(lambda a, b: a | b, [F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")) for n in names])
    return vectors.withColumn(names[0], F.when(checked, F.raise_error(F.lit("the vector has an entry that isn't finite")).cast("double")).otherwise(F.col(names[0])))


def slate_vectors(slate: DataFrame, base: DataFrame, goalies: DataFrame, starts: DataFrame, priors: DataFrame, announced: DataFrame | None = None, market: DataFrame | None = None, windows: list[int] = WINDOWS) -> DataFrame:
    """The vectors of games that haven't been played: see assemble. They are never stored with those of played games."""
    starters = project_starters(starts, slate, announced)
    out = assemble(slate, team_asof(base, slate, windows), starters, goalie_asof(goalies, starters, priors, windows), market, windows)
    return finite(out, feature_names(windows))


def score_slate(vectors: DataFrame, scorer: boosting.Scorer) -> DataFrame:
    """game_id, prob_home, market_available: refuses a scorer of other features."""
    names = [c for c in vectors.columns if c in set(scorer.features)]
    return boosting.score(vectors, scorer, names, "prob_home").select("game_id", "prob_home", "market_available")


def stored_vectors(vectors: DataFrame, names: list[str]) -> DataFrame:
    """game_id, names, vector: as they are written."""
    return vectors.select("game_id", F.array(*[F.lit(n) for n in names]).alias("names"), vector(names).alias("vector"))
