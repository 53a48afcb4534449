"""Joint score grids of one game as array<struct<h, a, p>>: low-score factors, tilts to a market, final scores and same-game legs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretime.functions import pmf
from foretime.functions.pmf import once

#: Chances that a tilt aims at are kept inside these.
TARGETS = (0.01, 0.99)


def mass(cells: Column, keep=None) -> Column:
    """The sum of p, over the cells that keep(h, a) takes."""
    part = (lambda x: x["p"]) if keep is None else (lambda x: F.when(keep(x["h"], x["a"]), x["p"]).otherwise(F.lit(0.0)))
    return F.aggregate(F.transform(cells, part), F.lit(0.0), lambda s, p: s + p)


def scaled(cells: Column, factor) -> Column:
    """Each p times factor(h, a), renormalised."""
    weighed = F.transform(cells, lambda x: F.struct(x["h"].alias("h"), x["a"].alias("a"), (x["p"] * factor(x["h"], x["a"])).alias("p")))
    return once(weighed, lambda w: once(mass(w), lambda s: F.transform(w, lambda x: F.struct(x["h"].alias("h"), x["a"].alias("a"), (x["p"] / s).alias("p")))))


def grid(home: Column, away: Column, margin_weights: list[float] | None = None, rho: Column | float = 0.0) -> Column:
    """The product of two PMFs, each cell times its margin's weight and the low-score factor of rho, renormalised.

    Factors, with the means m and n of home and away: 1 - m n rho at 0-0, 1 + m rho at 0-1, 1 + n rho at 1-0, 1 - rho at 1-1, never negative.
    """
    weights = F.array(*[F.lit(float(w)) for w in margin_weights or [1.0]])
    last = len(margin_weights or [1.0]) - 1
    rho = F.lit(float(rho)) if isinstance(rho, float) else rho
    product = lambda home, away: F.flatten(F.transform(home, lambda x, h: F.transform(away, lambda y, a: F.struct(h.alias("h"), a.alias("a"), (x * y).alias("p")))))

    def factor(means):
        low = lambda h, a: F.greatest(low_score(h, a, means["m"], means["n"], rho), F.lit(0.0))
        return lambda h, a: F.element_at(weights, F.least(F.abs(h - a), F.lit(last)) + 1) * low(h, a)

    means = lambda home, away: F.struct(pmf.mean(home).alias("m"), pmf.mean(away).alias("n"))
    return once(home, lambda p: once(away, lambda q: once(means(p, q), lambda m: scaled(product(p, q), factor(m)))))


def low_score(h: Column, a: Column, m: Column, n: Column, rho: Column) -> Column:
    """The factor of one cell."""
    return (
        F.when((h == 0) & (a == 0), 1 - m * n * rho).when((h == 0) & (a == 1), 1 + m * rho).when((h == 1) & (a == 0), 1 + n * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(F.lit(1.0))
    )


def settled_total(h: Column, a: Column) -> Column:
    """Goals that count for a total: a tie gets one more."""
    return h + a + (h == a).cast("int")


def over_without_push(cells: Column, line: Column) -> Column:
    return once(cells, lambda c: mass(c, lambda h, a: settled_total(h, a) > line) / (1 - mass(c, lambda h, a: settled_total(h, a) == line)))


def home_win(cells: Column, overtime: Column) -> Column:
    return once(cells, lambda c: mass(c, lambda h, a: h > a) + overtime * mass(c, lambda h, a: h == a))


def overtime_share(p_home: Column, slope: float = 0.15) -> Column:
    """The home side's chance in overtime: even, leaning with its chance to win, between 0.05 and 0.95."""
    return F.greatest(F.least(0.5 + F.lit(slope) * (p_home - 0.5), F.lit(0.95)), F.lit(0.05))


def _target(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(TARGETS[1])), F.lit(TARGETS[0]))


def _total(cells: Column, weight) -> Column:
    """The sum of weight(cell)."""
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + weight(x))


def tilt_total(cells: Column, p_over: Column, line: Column) -> Column:
    """Cells times exp(phi * total), so that over wins with p_over where there is no push; within a total nothing changes."""
    goals = lambda x: settled_total(x["h"], x["a"])

    def chance(c, phi):
        weight = lambda x: x["p"] * F.exp(phi * (x["t"] - 6))
        return _total(c["over"], weight) / _total(c["settled"], weight)

    # a total's cells are one, and those of a line are told apart before the search
    sums = lambda c: F.transform(F.array_distinct(F.transform(c, goals)), lambda t: F.struct(t.alias("t"), _total(F.filter(c, lambda x: goals(x) == t), lambda x: x["p"]).alias("p")))
    parts = lambda all_: F.struct(F.filter(all_, lambda x: x["t"] > line).alias("over"), F.filter(all_, lambda x: x["t"] != line).alias("settled"))
    tilt = lambda c: once(once(sums(c), parts), lambda x: pmf.bisect(lambda phi: chance(x, phi), _target(p_over), -5.0, 5.0))
    return once(cells, lambda c: once(tilt(c), lambda phi: scaled(c, lambda h, a: F.exp(phi * (settled_total(h, a) - 6)))))


def tilt_margin(cells: Column, p_home: Column, overtime: Column, most: int = 2 * pmf.LEVELS + 1) -> Column:
    """Cells times exp(theta * (h - a)), each total keeping its chance, so that home wins with p_home."""
    bent = lambda x, theta: x["p"] * F.exp(theta * (x["h"] - x["a"]))
    wins = lambda x: F.when(x["h"] > x["a"], F.lit(1.0)).when(x["h"] == x["a"], overtime).otherwise(F.lit(0.0))
    of_total = lambda c, t: F.filter(c, lambda x: settled_total(x["h"], x["a"]) == t)
    # the cells of each total with the chance that the total keeps; no cells settle at 0
    groups = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda t: once(of_total(cells, t), lambda g: F.struct(g.alias("cells"), _total(g, lambda x: x["p"]).alias("kept"))))
    groups = F.filter(groups, lambda g: g["kept"] > 0)

    def chance(all_, theta):
        part = lambda g: g["kept"] * _total(g["cells"], lambda x: bent(x, theta) * wins(x)) / _total(g["cells"], lambda x: bent(x, theta))
        return F.aggregate(all_, F.lit(0.0), lambda s, g: s + part(g))

    def rescaled(g, theta):
        return once(_total(g["cells"], lambda x: bent(x, theta)), lambda s: F.transform(g["cells"], lambda x: F.struct(x["h"].alias("h"), x["a"].alias("a"), (bent(x, theta) * g["kept"] / s).alias("p"))))

    return once(groups, lambda all_: once(pmf.bisect(lambda theta: chance(all_, theta), _target(p_home), -8.0, 8.0), lambda theta: F.flatten(F.transform(all_, lambda g: rescaled(g, theta)))))


def final_scores(cells: Column, overtime: Column) -> Column:
    """Cells of final scores: a tie becomes a win by one, home's with chance overtime. A score may stand in two cells."""

    def decided(c):
        won = F.transform(F.filter(c, lambda x: x["h"] == x["a"]), lambda x: F.struct((x["h"] + 1).alias("h"), x["a"].alias("a"), (x["p"] * overtime).alias("p")))
        lost = F.transform(F.filter(c, lambda x: x["h"] == x["a"]), lambda x: F.struct(x["h"].alias("h"), (x["a"] + 1).alias("a"), (x["p"] * (1 - overtime)).alias("p")))
        return F.concat(F.filter(c, lambda x: x["h"] != x["a"]), won, lost)

    return once(cells, decided)


def leg(market: str, side: str, line: Column | None = None, team: str | None = None):
    """(win, push) of a leg as functions of a final score: ml, total, team_total (of team) or spread (line is the side's handicap)."""
    own = (lambda h, a: h - a) if side == "HOME" else (lambda h, a: a - h)
    if market == "ml":
        return (lambda h, a: own(h, a) > 0), (lambda h, a: F.lit(False))
    if market == "spread":
        return (lambda h, a: own(h, a) + line > 0), (lambda h, a: own(h, a) + line == 0)
    goals = (lambda h, a: h + a) if market == "total" else (lambda h, a: h) if team == "HOME" else (lambda h, a: a)
    return (lambda h, a: goals(h, a) > line if side == "OVER" else goals(h, a) < line), (lambda h, a: goals(h, a) == line)


def price_legs(cells: Column, legs: list, decimals: list[Column]) -> Column:
    """struct(p_all_win, p_independent, multiplier) of legs on final scores: all win; the product of their chances; the expected payout of one unit, where a pushed leg pays 1."""
    def every(h, a):
        out = F.lit(True)
        for win, _ in legs:
            out = out & win(h, a)
        return out

    product, paid = F.lit(1.0), None
    for win, _ in legs:
        product = product * mass(cells, win)

    def pays(h, a):
        out = F.lit(1.0)
        for (win, push), d in zip(legs, decimals):
            out = out * F.when(win(h, a), d).when(push(h, a), F.lit(1.0)).otherwise(F.lit(0.0))
        return out

    paid = F.aggregate(F.transform(cells, lambda x: x["p"] * pays(x["h"], x["a"])), F.lit(0.0), lambda s, p: s + p)
    return F.struct(mass(cells, every).alias("p_all_win"), product.alias("p_independent"), paid.alias("multiplier"))


def market_scale(home_rate: Column, away_rate: Column, p_over: Column, line: Column, margin_weights: list[float] | None = None, low: float = 0.25, high: float = 4.0) -> Column:
    """The factor on both rates at which over wins with p_over where there is no push, found on a log scale in [low, high].

    A cell's chance under factor c is its chance under 1 times c to the power of its goals, but for a factor that all cells share.
    """
    levels = F.sequence(F.lit(0), F.lit(pmf.LEVELS))
    weights = F.array(*[F.lit(float(w)) for w in margin_weights or [1.0]])
    last = len(margin_weights or [1.0]) - 1
    term = lambda rate, k: F.pow(rate, k) / F.factorial(k)
    cell = lambda h, a: F.struct((h + a).alias("s"), settled_total(h, a).alias("t"), (term(home_rate, h) * term(away_rate, a) * F.element_at(weights, F.least(F.abs(h - a), F.lit(last)) + 1)).alias("p"))
    cells = F.flatten(F.transform(levels, lambda h: F.transform(levels, lambda a: cell(h, a))))

    def chance(all_, c):
        weight = lambda x: x["p"] * F.exp(c * x["s"])
        return _total(all_["over"], weight) / _total(all_["settled"], weight)

    parts = lambda all_: F.struct(F.filter(all_, lambda x: x["t"] > line).alias("over"), F.filter(all_, lambda x: x["t"] != line).alias("settled"))
    return F.exp(once(once(cells, parts), lambda all_: pmf.bisect(lambda c: chance(all_, c), p_over, math.log(low), math.log(high))))
