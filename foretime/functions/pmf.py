"""Probability mass functions as arrays: everything stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 12


def once(value: Column, f) -> Column:
    """f of a value that is computed once for each row: what stands in a lambda's body is computed each time that the lambda is called."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalised(pmf: Column) -> Column:
    """Divided by its sum. PMF and sum are taken once for each row."""
    return once(pmf, lambda q: once(F.aggregate(q, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(q, lambda x: x / s)))


def poisson(rate: Column, kmax: int = LEVELS) -> Column:
    """0..kmax, renormalised. Each term comes from the one before it, so no factorial overflows."""
    step = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * rate / k))
    return normalised(F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), F.array(F.exp(-rate)), step))


def negative_binomial(mean: Column, alpha: float, kmax: int = 15) -> Column:
    """NB2 with variance mean + alpha * mean^2, 0..kmax, renormalised; Poisson where alpha is 0."""
    if alpha <= 0:
        return poisson(mean, kmax)
    r = 1 / alpha
    p = mean * alpha / (1 + mean * alpha)
    first = F.pow(1 / (1 + mean * alpha), F.lit(r))
    step = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * p * (k - 1 + r) / k))
    return normalised(F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), F.array(first), step))


def joint(home: Column, away: Column, margin_weights: list[float] | None = None) -> Column:
    """array<array<double>> of home x away, each cell weighted by min(|h - a|, last weight), renormalised."""
    weights = F.array(*[F.lit(float(w)) for w in margin_weights or [1.0]])
    last = len(margin_weights or [1.0]) - 1
    weigh = lambda h, a: F.element_at(weights, F.least(F.abs(h - a), F.lit(last)) + 1)
    grid = once(home, lambda p: once(away, lambda q: F.transform(p, lambda x, h: F.transform(q, lambda y, a: x * y * weigh(h, a)))))
    total = lambda g: F.aggregate(F.flatten(g), F.lit(0.0), lambda s, x: s + x)
    return once(grid, lambda g: once(total(g), lambda s: F.transform(g, lambda row: F.transform(row, lambda x: x / s))))


def total_of(grid: Column, kmax: int = LEVELS) -> Column:
    """PMF of the sum of the two scores; a tie adds one, for the goal that decides it."""
    cells = F.flatten(F.transform(grid, lambda row, h: F.transform(row, lambda p, a: F.struct((h + a + (h == a).cast("int")).alias("t"), p.alias("p")))))
    at = lambda all_, t: F.aggregate(F.filter(all_, lambda c: c["t"] == t), F.lit(0.0), lambda s, c: s + c["p"])
    return once(cells, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(2 * kmax + 1)), lambda t: at(all_, t)))


def home_win(grid: Column, overtime: Column) -> Column:
    """P(home > away) plus overtime's share of the ties."""
    part = lambda keep: F.aggregate(F.flatten(F.transform(grid, lambda row, h: F.transform(row, lambda p, a: F.when(keep(h, a), p).otherwise(F.lit(0.0))))), F.lit(0.0), lambda s, x: s + x)
    return part(lambda h, a: h > a) + overtime * part(lambda h, a: h == a)


def over(pmf: Column, line: Column) -> Column:
    """P(value > line)."""
    return F.aggregate(F.transform(pmf, lambda p, k: F.when(k > line, p).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def push(pmf: Column, line: Column) -> Column:
    """P(value = line)."""
    return F.aggregate(F.transform(pmf, lambda p, k: F.when(k == line, p).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def mean(pmf: Column) -> Column:
    return F.aggregate(F.transform(pmf, lambda p, k: p * k), F.lit(0.0), lambda s, x: s + x)


def nll(pmf: Column, value: Column) -> Column:
    """-ln of the mass at value; NULL outside of the support."""
    return -F.ln(F.try_element_at(pmf, value.cast("int") + 1))


def middle_value(pmf: Column, low: Column, high: Column, dec_over: Column, dec_under: Column) -> Column:
    """Expected profit of one unit on over low and one on under high."""
    each = F.transform(
        pmf,
        lambda p, k: p
        * (
            F.when(k > low, dec_over - 1).when(k == low, F.lit(0.0)).otherwise(F.lit(-1.0))
            + F.when(k < high, dec_under - 1).when(k == high, F.lit(0.0)).otherwise(F.lit(-1.0))
        ),
    )
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def tilted(pmf: Column, line: Column, chance: Column) -> Column:
    """The PMF with each mass times exp(theta * value), renormalised; theta is such that, the line itself left out, the mass above it is chance."""
    total = lambda q: F.aggregate(q, F.lit(0.0), lambda s, x: s + x)
    weighed = lambda q, theta: F.transform(q, lambda p, k: p * F.exp(theta * k))

    def bent(q: Column) -> Column:
        above = lambda theta: once(weighed(q, theta), lambda w: over(w, line) / (total(w) - push(w, line)))
        return once(bisect(above, chance, -5.0, 5.0), lambda theta: normalised(weighed(q, theta)))

    return once(pmf, bent)


def bisect(f, target: Column, low: float, high: float, steps: int = 40) -> Column:
    """x with f(x) = target for a rising f, by halving [low, high] steps times."""
    start = F.struct(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        return once(f(mid) < target, lambda below: F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def sides(pmf: Column, line: Column) -> Column:
    """struct(over, under, push): the push's mass is taken out of the first two."""
    both = once(pmf, lambda q: F.struct(push(q, line).alias("p"), over(q, line).alias("o")))
    return once(both, lambda b: F.struct((b["o"] / (1 - b["p"])).alias("over"), ((1 - b["p"] - b["o"]) / (1 - b["p"])).alias("under"), b["p"].alias("push")))


def implied_mean(chance: Column, line: Column, alpha: float, low: float = 0.05, high: float = 12.0, kmax: int = 40) -> Column:
    """The mean at which the negative binomial's over, without the push, has that chance."""
    return bisect(lambda m: sides(negative_binomial(m, alpha, kmax), line)["over"], chance, low, high)
