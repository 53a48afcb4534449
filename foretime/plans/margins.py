"""Weights of score cells by their margin, fitted to how often each margin was seen."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions import pmf
from foretime.sources.shared import written

#: Fixed value: margins from this one on share a weight, which is 1.
CAP = 4


def margin_masses(home: Column, away: Column) -> Column:
    """The chance of a tie, a margin of 1, 2, ..., CAP and more, from the distributions of both sides' goals (arrays from 0 on), before any weight."""
    diagonal = lambda b: F.aggregate(F.zip_with(F.slice(home, 1, F.size(home) - b), F.slice(away, b + 1, F.size(away) - b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mirrored = lambda b: F.aggregate(F.zip_with(F.slice(home, b + 1, F.size(home) - b), F.slice(away, 1, F.size(away) - b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    small = [diagonal(0), *[diagonal(b) + mirrored(b) for b in range(1, CAP)]]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rest = total(home) * total(away)
    for x in small:
        rest = rest - x
    return F.array(*small, F.greatest(rest, F.lit(0.0)))


def margin_bucket(home: Column, away: Column) -> Column:
    return F.least(F.abs(home - away), F.lit(CAP)).cast("int")


def fit_margin_weights(games: DataFrame, masses: str, bucket: str, tolerance: float = 1e-10, most: int = 60) -> list[float]:
    """The likeliest weights (CAP + 1 numbers, the last one 1) of games with masses and the bucket of the result.

    Games of equal masses are one cell with their number, written once. A round is one aggregation over the cells: the shares that
    the weights give each margin, and how they move together, which make a Newton step on the logarithms. The
    likelihood has one peak; at it the fitted shares equal the observed ones. A step that makes them differ more is
    taken in proportion to the misfit instead (iterative proportional fitting), which always brings them nearer. A margin that was never seen has
    the weight 0.
    """
    known = games.filter(F.col(bucket).isNotNull() & F.col(masses).isNotNull())
    cells = written(known.groupBy(masses).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(bucket) == b).alias(f"seen{b}") for b in range(CAP + 1)]), "margin-cells")
    seen = cells.agg(F.sum("n").alias("n"), *[F.sum(f"seen{b}").alias(f"s{b}") for b in range(CAP + 1)]).first()
    if not seen["n"]:
        raise ValueError("there are no games to fit to")
    if not seen[f"s{CAP}"]:
        raise ValueError(f"no game has a margin of {CAP} or more, which the weights are relative to")
    share = np.array([seen[f"s{b}"] / seen["n"] for b in range(CAP + 1)])

    def fitted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = [F.col(masses)[b] * float(w[b]) for b in range(CAP + 1)]
        z = sum(part[1:], part[0])
        p = [x / z for x in part]
        mean = lambda c: F.sum(F.col("n") * c) / F.lit(seen["n"])
        r = cells.agg(*[mean(p[b]).alias(f"p{b}") for b in range(CAP + 1)], *[mean(p[a] * p[b]).alias(f"c{a}{b}") for a in range(CAP) for b in range(a, CAP)]).first()
        first = np.array([r[f"p{b}"] for b in range(CAP + 1)])
        together = np.array([[r[f"c{min(a, b)}{max(a, b)}"] for b in range(CAP)] for a in range(CAP)])
        return first, np.diag(first[:CAP]) - together

    w = np.where(share > 0, 1.0, 0.0)
    shown, curve = fitted(w)
    for _ in range(most):
        miss = np.abs(shown - share).max()
        if miss < tolerance:
            break
        live = np.flatnonzero(share[:CAP] > 0)
        step = np.zeros(CAP)
        step[live] = np.linalg.lstsq(curve[np.ix_(live, live)], (share - shown)[live], rcond=None)[0]
        tried = w.copy()
        tried[:CAP] *= np.exp(np.clip(step, -2, 2))
        there = fitted(tried)
        if not np.abs(there[0] - share).max() < miss:
            tried = np.where(share > 0, w * share / np.where(shown > 0, shown, 1.0), 0.0)
            tried = tried / tried[CAP]
            there = fitted(tried)
        w, (shown, curve) = tried, there
    return [float(x) for x in w]


def fitted_shares(games: DataFrame, masses: str, bucket: str, weights: list[float]) -> DataFrame:
    """bucket, observed, fitted, weight: how often each margin was seen and is expected."""
    part = F.transform(F.col(masses), lambda m, k: m * F.element_at(F.array(*map(F.lit, weights)), k + 1))
    rows = games.filter(F.col(bucket).isNotNull() & F.col(masses).isNotNull()).select(F.posexplode(pmf.normalised(part)).alias("bucket", "p"), F.col(bucket).alias("seen"))
    out = rows.groupBy("bucket").agg(F.avg((F.col("seen") == F.col("bucket")).cast("double")).alias("observed"), F.avg("p").alias("fitted"))
    return out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("bucket") + 1))
