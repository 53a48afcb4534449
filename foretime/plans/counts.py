"""Counts of players: a Poisson booster on an exposure baseline, its dispersion, scores and gates, and the check against prices.

Scores are aggregations over all rows; a pooled line stands beside those of the venues in the same aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions.prices import decimal_odds
from foretime.operators.stats import log_loss
from foretime.plans import boosting
from foretime.plans.models import _each_fold, core_and_tail, with_drift

#: Means are held within these, dispersions too; what a gate asks for.
MEAN_RANGE, ALPHA_RANGE = (0.05, 12.0), (0.0, 2.0)
GATE_SE, GATE_FOLDS, GATE_ECE, GATE_ROWS, GATE_Z = 2.0, 4, 0.03, 500, 1.96
POOLED = "POOLED"


def window_rate(df: DataFrame, count: str = "sog", seconds: str = "toi") -> float:
    """Counts per hour of all rows."""
    return df.agg(F.sum(count) * 3600 / F.sum(seconds)).first()[0]  # one number


def exposure(rate: Column, seconds: Column, league: Column, window: float) -> Column:
    """Expected count: the player's rate for his expected time, moved by the league's present rate against that of the training window."""
    if not window or not math.isfinite(window) or window <= 0:
        raise ValueError(f"the training window's rate must be positive, not {window}")
    return rate * seconds / 3600 * league / F.lit(float(window))


def log_factorial(y: Column) -> Column:
    return F.aggregate(F.when(y >= 1, F.sequence(F.lit(1), y.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.ln(k))


def count_nll(y: Column, mu: Column, alpha: Column | float) -> Column:
    """-ln of the negative binomial's mass with variance mu + alpha * mu^2; Poisson's where alpha is 0. y is a whole number."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    poisson = mu - y * F.ln(mu) + log_factorial(y)
    r = 1 / F.when(a > 1e-10, a)
    rising = F.aggregate(F.when(y >= 1, F.sequence(F.lit(0), y.cast("int") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.ln(r + k))
    return F.when(a > 1e-10, -(rising - log_factorial(y) + r * F.ln(r / (r + mu)) + y * F.ln(mu / (r + mu)))).otherwise(poisson)


def fit_alpha(df: DataFrame, y: str, mu: str, passes: int = 5, points: int = 20) -> float:
    """The likeliest dispersion within ALPHA_RANGE: passes over ever finer grids, each one aggregation; 0 where Poisson is as good."""
    low, high = ALPHA_RANGE
    best = 0.0
    for _ in range(passes):
        grid = [low + (high - low) * k / points for k in range(points + 1)]
        r = df.agg(*[F.avg(count_nll(F.col(y), F.col(mu), g)).alias(str(k)) for k, g in enumerate(grid)]).first()
        k = min(range(points + 1), key=lambda k: r[str(k)])
        best, step = grid[k], (high - low) / points
        low, high = max(ALPHA_RANGE[0], best - step), min(ALPHA_RANGE[1], best + step)
    return best if best > 1e-6 else 0.0


def walk_forward_counts(df: DataFrame, features: list[str], settings: boosting.Settings, label: str = "sog", purge_days: int = 7, prior_rows: float = 25.0) -> DataFrame:
    """df's predictable seasons with fold, base, mu (booster on the base), mu_drift (its level of the season taken out) and alpha, fitted on the seasons before.

    df: the columns of player_features. The dispersion is that of the training window's last days around the booster's means.
    """
    out = None
    clip = lambda c: F.greatest(F.least(c, F.lit(MEAN_RANGE[1])), F.lit(MEAN_RANGE[0]))
    for fold, train, validate in _each_fold(df, purge_days):
        rate = window_rate(train, label)
        base = exposure(F.col("shrunk_sog60"), F.col("exp_toi"), F.col("league_pos_sog60"), rate)
        train, validate = (x.withColumn("base", base).filter("base > 0") for x in (train, validate))
        trees = boosting.fit(train, features, label, F.ln("base"), "date", settings)
        predicted = lambda x: boosting.adjustment(x, trees, "__adj").withColumn("mu", clip(F.col("base") * F.exp("__adj")))  # noqa: E731, B023
        alpha = fit_alpha(predicted(core_and_tail(train, "date").filter("part = 'tail'")), label, "mu")
        one = with_drift(predicted(validate).withColumn("__r", F.ln("mu") - F.ln("base")), "__r", prior_rows)
        one = one.withColumn("mu_drift", clip(F.col("mu") * F.exp(-F.col("shift")))).withColumns({"alpha": F.lit(alpha), "fold": F.lit(fold)}).drop("__adj", "__r", "shift")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.limit(0)


def _pooled(df: DataFrame, by: str) -> DataFrame:
    """Every row twice: under its group and under POOLED."""
    return df.withColumn("__g", F.explode(F.array(F.col(by).cast("string"), F.lit(POOLED)))).drop(by).withColumnRenamed("__g", by)


def score_counts(df: DataFrame, by: str, models: dict[str, tuple[str, Column | float]], y: str = "sog", against: str | None = None) -> DataFrame:
    """For each group of by and pooled: n, mean count, and for each model (name -> mean column, dispersion) its mean nll, mean and bias; with against (a name), the mean difference of the others' nll from its, and the error of that."""
    rows = df.withColumns({f"__nll_{m}": count_nll(F.col(y), F.col(mu), a) for m, (mu, a) in models.items()})
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_count")]
    for m, (mu, _) in models.items():
        aggs += [F.avg(f"__nll_{m}").alias(f"nll_{m}"), F.avg(mu).alias(f"mean_{m}"), (F.avg(mu) - F.avg(y)).alias(f"bias_{m}")]
        if against and m != against:
            d = F.col(f"__nll_{m}") - F.col(f"__nll_{against}")
            aggs += [F.avg(d).alias(f"diff_{m}"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias(f"se_{m}")]
    return _pooled(rows, by).groupBy(by).agg(*aggs)


def gate(scores: DataFrame, by: str, model: str, baseline: str) -> DataFrame:
    """better (by GATE_SE errors, pooled), folds_won, passed: scores of score_counts against the baseline."""
    d, se = F.col(f"diff_{model}"), F.col(f"se_{model}")
    pooled = F.col(by) == POOLED
    better = F.max(F.when(pooled, d <= -GATE_SE * se))
    won = F.count_if(~pooled & (F.col(f"nll_{model}") < F.col(f"nll_{baseline}")))
    return scores.agg(better.alias("better"), won.alias("folds_won")).withColumn("passed", F.col("better") & (F.col("folds_won") >= GATE_FOLDS))


def adopted(start: str, order: list[str], better: dict[tuple[str, str], tuple[float, float, int]], gates: dict[str, bool], folds: int = GATE_FOLDS) -> list[tuple[str, str, bool]]:
    """(variant, against, adopted) in order: a variant takes over when it passed its gate and beats the present one by GATE_SE errors and in so many folds. better: (variant, against) -> difference, error, folds won."""
    now, out = start, []
    for variant in order:
        if variant not in gates:
            continue
        diff, se, won = better[(variant, now)]
        takes = bool(gates[variant] and diff <= -GATE_SE * se and won >= folds)
        out.append((variant, now, takes))
        now = variant if takes else now
    return out


def with_outcomes(props: DataFrame, played: DataFrame, keys: list[str]) -> DataFrame:
    """props (keys, line, sog as the model saw it) with shots, pushes left out, and over_hit. A prop without an outcome, or with another than the model's, is an error of the data."""
    rows = props.join(played.select(*keys, "shots").dropDuplicates(keys), keys, "left")
    wrong = F.when(F.col("shots").isNull(), F.raise_error(F.lit("a prop has no outcome"))).when(F.col("shots") != F.col("sog"), F.raise_error(F.lit("an outcome disagrees with the model's count")))
    shots = F.when(wrong.isNotNull(), wrong.cast("int")).otherwise(F.col("shots"))
    return rows.withColumn("shots", shots).filter(F.col("shots") != F.col("line")).withColumn("over_hit", (F.col("shots") > F.col("line")).cast("double"))


def against_prices(df: DataFrame, by: str = "book", game: str = "game_id", model: str = "p_model", market: str = "p_mkt", y: str = "over_hit") -> DataFrame:
    """For each venue and pooled: n, games, rates, log losses of model and market, their mean difference, its error clustered by game, the upper end, Brier scores, and whether the model beats the market.

    Differences are added up by game first, so an error takes one row for each game.
    """
    yy, pm, pk = F.col(y), F.col(model), F.col(market)
    d = log_loss(yy, pm) - log_loss(yy, pk)
    rows = _pooled(df.select(by, game, yy.alias("y"), pm.alias("pm"), pk.alias("pk"), log_loss(yy, pm).alias("lm"), log_loss(yy, pk).alias("lk"), d.alias("d")), by)
    sq = lambda p: F.sum(F.pow(F.col(p) - F.col("y"), 2))
    per = rows.groupBy(by, game).agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"t_{c}") for c in ("y", "pm", "pk", "lm", "lk")], sq("pm").alias("t_bm"), sq("pk").alias("t_bk"))
    t = per.groupBy(by).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("games"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("k")).alias("sk"), F.sum(F.col("k") * F.col("k")).alias("kk"), *[F.sum(f"t_{c}").alias(c) for c in ("y", "pm", "pk", "lm", "lk", "bm", "bk")])
    mean = F.col("s") / F.col("n")
    spread = F.greatest(F.col("ss") - 2 * mean * F.col("sk") + mean * mean * F.col("kk"), F.lit(0.0))
    se = F.when(F.col("games") > 1, F.sqrt(F.col("games") / (F.col("games") - 1) * spread) / F.col("n"))
    of = lambda c: F.col(c) / F.col("n")
    out = t.select(by, "n", "games", of("y").alias("over_rate"), of("pm").alias("mean_model"), of("pk").alias("mean_market"), of("lm").alias("loss_model"), of("lk").alias("loss_market"), mean.alias("diff"), se.alias("se"), of("bm").alias("brier_model"), of("bk").alias("brier_market"))
    upper = F.col("diff") + GATE_Z * F.col("se")
    return out.withColumn("upper", upper).withColumn("beats_market", F.coalesce((F.col("n") >= GATE_ROWS) & (upper < 0), F.lit(False)))


def check_passed(results: DataFrame, by: str = "book") -> DataFrame:
    """pooled_beats, books_against (venues of GATE_ROWS or more rows where the model isn't ahead), passed."""
    pooled = F.col(by) == POOLED
    against = F.count_if(~pooled & (F.col("n") >= GATE_ROWS) & ~(F.col("diff") < 0))
    return results.agg(F.coalesce(F.bool_or(F.when(pooled, F.col("beats_market"))), F.lit(False)).alias("pooled_beats"), against.alias("books_against")).withColumn("passed", F.col("pooled_beats") & (F.col("books_against") == 0))


def level_constants(df: DataFrame, by: str = "book", shots: str = "shots", mu: str = "mu") -> DataFrame:
    """For each venue the mean count over the mean of the model on its props."""
    return df.groupBy(by).agg((F.avg(shots) / F.avg(mu)).alias("level"))


def over_only(props: DataFrame, thresholds: list[float]) -> DataFrame:
    """Bets on one-sided overs (game_id, p_model, over price now and at the opening, updated, start, shots, line): threshold, props, bets, hits, profit, roi; a price from during the game isn't one, and no margin can be taken out."""
    pregame = F.coalesce(F.col("updated") < F.col("start"), F.lit(False))
    price = F.coalesce(F.when(pregame, F.col("over_price")), F.col("over_price_open"))
    rows = props.withColumn("d", decimal_odds(price)).filter("d IS NOT NULL").withColumn("hit", F.col("shots") > F.col("line"))
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    bet = F.col("p_model") - 1 / F.col("d") >= F.col("threshold") - 1e-12
    gain = F.when(bet, F.when(F.col("hit"), F.col("d") - 1).otherwise(-1.0))
    out = each.groupBy("threshold").agg(F.count(F.lit(1)).alias("props"), F.count_if(bet).alias("bets"), F.count_if(bet & F.col("hit")).alias("hits"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("profit"))
    return out.withColumn("roi", F.when(F.col("bets") > 0, F.col("profit") / F.col("bets")))
