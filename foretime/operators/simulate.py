"""Monte Carlo seasons: simulations are rows, dealt over the cluster, each with its own seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seasons(spark: SparkSession, days: list[list[tuple[float, float, float]]], sims: int, n_days: int, cap: float = 0.10, start: float = 1000.0, seed: int = 1, scale: bool = False) -> DataFrame:
    """sim, final, drawdown, ruined of simulated seasons that draw n_days of the given days with replacement.

    days: for each day its bets (stake share, gain on win, chance to win), strongest first: a table of at most some hundred days.
    Stakes over the daily cap are skipped, or with scale all scaled down. Simulations differ only by their number, so a lost task repeats with the same result.
    """
    sent = spark.sparkContext.broadcast(days)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value
        for frame in frames:
            out = []
            for sim in frame["id"]:
                rnd = np.random.default_rng([seed, int(sim)])
                balance = peak = start
                worst = 0.0
                for day in rnd.integers(0, len(table), n_days):
                    bets = np.array(table[day]).reshape(-1, 3)
                    stake = bets[:, 0]
                    if scale:
                        stake = stake * min(1.0, cap / max(stake.sum(), 1e-12))
                    else:
                        keep, used = np.zeros(len(stake)), 0.0
                        for k, s in enumerate(stake):
                            if used + s <= cap + 1e-9:
                                keep[k], used = 1, used + s
                        stake = stake * keep
                    won = rnd.random(len(stake)) < bets[:, 2]
                    balance *= 1 + float((stake * np.where(won, bets[:, 1], -1.0)).sum())
                    peak = max(peak, balance)
                    worst = max(worst, 1 - balance / peak)
                out.append((int(sim), balance, worst, balance < 0.1 * start))
            yield pd.DataFrame(out, columns=["sim", "final", "drawdown", "ruined"])

    return spark.range(sims).mapInPandas(run, "sim long, final double, drawdown double, ruined boolean")


def summary(sims: DataFrame, start: float = 1000.0) -> DataFrame:
    """p5, p50, p95 of the final balance, the shares ruined and at a loss, the median drawdown."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    return sims.agg(
        p("final", 0.05).alias("p5"),
        p("final", 0.5).alias("p50"),
        p("final", 0.95).alias("p95"),
        F.avg(F.col("ruined").cast("double")).alias("ruined"),
        F.avg((F.col("final") < start).cast("double")).alias("lost"),
        p("drawdown", 0.5).alias("drawdown"),
    )
