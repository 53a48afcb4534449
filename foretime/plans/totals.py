"""Goals of a game: a row for each attack, boosted on the league's present rate, and the check of totals against prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.functions.prices import fair
from foretime.operators.reshape import sides
from foretime.operators.stats import log_loss
from foretime.plans import boosting
from foretime.plans.features import WINDOWS
from foretime.plans.models import with_drift
from foretime.plans.slate import GOALIE_RATES

#: What an attack and a defence give, and the rates that are set against the league's.
ATTACK = ("gf_per60", "sh_pct", "pp_pct", "pp_xgf_per60", "pim_per60", "xgf_pct")
DEFENCE = ("ga_per60", "sv_pct", "pk_pct", "pk_xga_per60", "pim_per60")
PER_HOUR = ("gf_per60", "ga_per60", "pp_xgf_per60", "pk_xga_per60")
RATE_RANGE, CHECK_GAMES = (0.4, 8.0), 200
_SIDE = ("rest", "b2b", "travel_km", "elo")


def attack_names(windows: list[int] = WINDOWS, attack: tuple[str, ...] = ATTACK, defence: tuple[str, ...] = DEFENCE) -> list[str]:
    out = [n for w in windows for n in (*(f"off_{s}_w{w}" for s in attack), *(f"def_{s}_w{w}" for s in defence), f"off_gp_w{w}", f"def_gp_w{w}")]
    out += [f"goalie_{s}_w{w}" for w in windows for s in GOALIE_RATES]
    return [*out, "is_home", "is_playoff", "off_rest", "def_rest", "off_b2b", "def_b2b", "off_travel_km", "def_travel_km", "elo_edge", "game_num", "stage_early", "stage_late", "starter_fallback"]


def attack_rows(games: DataFrame, team: DataFrame, goalie: DataFrame, windows: list[int] = WINDOWS, attack: tuple[str, ...] = ATTACK, defence: tuple[str, ...] = DEFENCE, env: str | None = None) -> DataFrame:
    """Two rows for each game (game_id, season, date, is_home, team, goals, total, names of attack_names): an attack against the other side's defence and goalie.

    games: as for slate.assemble, with game_type, home_starter, away_starter. team and goalie: rates before the game by window. With env, a column of
    the league's goals of a game, goal rates are divided by half of it, so they say how a side stands against the league now.
    """
    own = lambda p, other: {"team": p, "opp": other, "goals": f"{p}_score", "def_starter": f"{other}_starter", "game_num": f"{p}_game_num"} | {f"off_{c}": f"{p}_{c}" for c in _SIDE} | {f"def_{c}": f"{other}_{c}" for c in _SIDE}
    common = ["game_id", "season", "date", "game_type", "stage"] + ([env] if env else [])
    rows = sides(games.withColumn("__total", F.col("home_score") + F.col("away_score")), [*common, "__total"], own("home", "away"), own("away", "home"))
    pick = lambda p, key, names: team.select("game_id", F.col("team").alias(key), *[F.col(f"{s}_{w}").alias(f"{p}_{s}_w{w}") for w in windows for s in names], *[F.col(f"games_{w}").cast("double").alias(f"{p}_gp_w{w}") for w in windows])
    keeper = goalie.select("game_id", F.col("goalie_id").alias("def_starter"), *[F.col(f"{s}_{w}").alias(f"goalie_{s}_w{w}") for w in windows for s in GOALIE_RATES])
    out = rows.join(pick("off", "team", attack), ["game_id", "team"], "left").join(pick("def", "opp", defence), ["game_id", "opp"], "left").join(keeper, ["game_id", "def_starter"], "left")
    number = lambda c: F.col(c).cast("double")
    stage = lambda s: F.coalesce(F.col("stage") == s, F.lit(False)).cast("double")
    made: dict[str, Column] = {"is_home": number("is_home"), "is_playoff": (F.col("game_type") == 3).cast("double"), "elo_edge": number("off_elo") - number("def_elo"), "game_num": number("game_num"), "stage_early": stage("EARLY"), "stage_late": stage("LATE"), "starter_fallback": F.col("def_starter").isNull().cast("double")}
    made |= {f"{p}_{c}": number(f"{p}_{c}") for p in ("off", "def") for c in ("rest", "travel_km")} | {f"{p}_b2b": F.coalesce(F.col(f"{p}_b2b"), F.lit(False)).cast("double") for p in ("off", "def")}
    if env:
        made |= {n: F.col(n) / (F.col(env) / 2) for w in windows for p, names in (("off", attack), ("def", defence)) for s in names if s in PER_HOUR for n in [f"{p}_{s}_w{w}"]}
    names = attack_names(windows, attack, defence)
    return out.select("game_id", "season", "date", "team", "goals", F.col("__total").alias("total"), *([env] if env else []), *[made.get(n, F.col(n)).alias(n) for n in names])


def variant(names: list[str], roles: tuple[str, ...], goalie: bool = True, role: bool = False) -> list[str]:
    """The features of an experiment: with or without the goalie's form, with or without his role."""
    return [n for n in [*names, *(roles if role else ())] if goalie or not n.startswith("goalie_")]


def goal_rates(train: DataFrame, score: DataFrame, features: list[str], env: str, settings: boosting.Settings, prior_rows: float = 25.0) -> DataFrame:
    """score (rows of attack_rows) with rate: a Poisson booster on the league's rate of a side, fitted on train, whose level of the season so far is taken out."""
    base = F.ln(F.col(env) / 2)
    trees = boosting.fit(train.filter(f"{env} > 0"), features, "goals", base, "date", settings)
    out = with_drift(boosting.adjustment(score, trees, "__adj"), "__adj", prior_rows)
    rate = F.exp(base + F.col("__adj") - F.col("shift"))
    return out.withColumn("rate", F.greatest(F.least(rate, F.lit(RATE_RANGE[1])), F.lit(RATE_RANGE[0]))).drop("__adj", "shift")


def closing_totals(rows: DataFrame) -> DataFrame:
    """game_id, book, line, over_price, under_price: of each venue the last snapshot strictly before the start that has both sides at one line. rows: game_id, book, side, price, point, at, start."""
    known = rows.filter((F.col("at") < F.col("start")) & F.col("price").isNotNull() & F.col("point").isNotNull())
    side = lambda s, c: F.max_by(c, F.when(F.col("side") == s, F.struct("price", "point")))
    both = known.groupBy("game_id", "book", "at").agg(side("over", "price").alias("over_price"), side("over", "point").alias("line"), side("under", "price").alias("under_price"), side("under", "point").alias("__under"))
    both = both.filter(F.col("line") == F.col("__under"))
    last = both.groupBy("game_id", "book").agg(F.max_by(F.struct("line", "over_price", "under_price"), "at").alias("r"))
    return last.select("game_id", "book", "r.*")


def market_overs(quotes: DataFrame) -> DataFrame:
    """game_id, line, fair_over, n_books: the line that most venues quote, of equal ones the most balanced, and the median of their fair chances of the over. quotes: game_id, line, over_price, under_price."""
    q = quotes.filter("line IS NOT NULL AND over_price IS NOT NULL AND under_price IS NOT NULL")
    by = q.groupBy("game_id", "line").agg(F.median(fair(F.col("over_price"), F.col("under_price"))).alias("fair_over"), F.count(F.lit(1)).alias("n_books"))
    best = by.groupBy("game_id").agg(F.max_by(F.struct("line", "fair_over", "n_books"), F.struct("n_books", -F.abs(F.col("fair_over") - 0.5), -F.col("line"))).alias("r"))
    return best.select("game_id", "r.*")


def totals_check(df: DataFrame, least: int = CHECK_GAMES) -> DataFrame:
    """n, model_loss, market_loss, diff, se, beats_market over games (p_over, p_push, fair_over, total, line) without pushes; NULL under so many games."""
    clip = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    model, market = clip(F.col("p_over") / F.greatest(1 - F.col("p_push"), F.lit(1e-12))), clip(F.col("fair_over"))
    y = (F.col("total") > F.col("line")).cast("double")
    rows = df.filter(F.col("total") != F.col("line")).select(log_loss(y, model).alias("a"), log_loss(y, market).alias("b"))
    d = F.col("a") - F.col("b")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("model_loss"), F.avg("b").alias("market_loss"), F.avg(d).alias("diff"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))
    return out.withColumn("beats_market", F.when(F.col("n") >= least, F.col("diff") + 1.96 * F.col("se") < 0))


def closes_by_season(lines: DataFrame) -> DataFrame:
    """season, games, with_close, medians of spread, overround and minutes before the start, of exchange closes (game_id, season, side, bid, ask, at, start): a close has both sides, each with a bid over 0 and an ask under 1."""
    ok = F.coalesce((F.col("bid") > 0) & (F.col("ask") < 1), F.lit(False))
    w = Window.partitionBy("game_id")
    rows = lines.withColumns({"__close": (F.count(F.lit(1)).over(w) == 2) & (F.count_if(ok).over(w) == 2), "__sum": F.sum("ask").over(w) - 1, "__first": F.row_number().over(w.orderBy("side")) == 1})
    of = lambda c, cond: F.round(F.median(F.when(F.col("__close") & cond, c)), 4)
    lead = (F.unix_micros("start") - F.unix_micros("at")) / 6e7
    return rows.groupBy("season").agg(F.countDistinct("game_id").alias("games"), F.count_if(F.col("__close") & F.col("__first")).alias("with_close"), of(F.col("ask") - F.col("bid"), F.lit(True)).alias("median_spread"), of(F.col("__sum"), F.col("__first")).alias("median_overround"), of(lead, F.lit(True)).alias("median_lead_min"))
