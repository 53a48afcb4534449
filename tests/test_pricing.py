"""Distributions and grids are made once for each row, however often a formula names them."""

import math

from pyspark.sql import functions as F

from foretime.functions import grids, pmf
from foretime.plans import margins


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rates(spark):
    return spark.createDataFrame([(2.2, 1.9, 0.55, 5.5), (3.1, 2.4, 0.4, 6.0)], "h double, a double, p double, line double")


def test_a_distribution_stands_once_in_a_formula(spark):
    home, away = pmf.poisson(F.col("h")), pmf.poisson(F.col("a"))
    weights = [1.1, 0.8, 1.0]
    made = {
        "total": pmf.total_of(pmf.joint(home, away, weights)), "over": grids.over_without_push(grids.grid(home, away, weights), F.col("line")), "win": grids.home_win(grids.grid(home, away, weights), F.lit(0.5)),
        "final": grids.final_scores(grids.grid(home, away, weights), F.lit(0.5)), "tilted": grids.tilt_total(grids.grid(home, away, weights), F.col("p"), F.col("line")).getItem(0)["p"],
    }
    for name, c in made.items():
        text = plan(rates(spark).select(c.alias(name)))
        assert text.count("EXP(-h#") == 1 and text.count("EXP(-a#") == 1, name


def test_a_search_names_its_function_once(spark):
    text = plan(rates(spark).select(pmf.bisect(lambda x: F.sinh(x), F.col("p"), -5.0, 5.0).alias("x")))
    assert text.count("SINH(") == 1
    one = plan(rates(spark).select(pmf.implied_mean(F.col("p"), F.col("line"), 0.12).alias("m")))
    assert one.upper().count("POWER(") == 1


def test_tilts_and_scales_reach_their_chances(spark):
    g = grids.grid(pmf.poisson(F.col("h")), pmf.poisson(F.col("a")), [1.1, 0.8, 1.0])
    c = grids.market_scale(F.col("h"), F.col("a"), F.col("p"), F.col("line"), [1.1, 0.8, 1.0])
    scaled = grids.grid(pmf.poisson(F.col("h") * c), pmf.poisson(F.col("a") * c), [1.1, 0.8, 1.0])
    for r in rates(spark).select("p", grids.over_without_push(grids.tilt_total(g, F.col("p"), F.col("line")), F.col("line")).alias("t"), grids.over_without_push(scaled, F.col("line")).alias("s")).collect():
        assert math.isclose(r["t"], r["p"], abs_tol=1e-8) and math.isclose(r["s"], r["p"], abs_tol=1e-8)


def test_shares_of_margins_are_made_once_for_each_game(spark):
    g = spark.createDataFrame([([0.2, 0.3, 0.2, 0.2, 0.1], 0), ([0.1, 0.3, 0.2, 0.2, 0.2], 4)], "m array<double>, b int")
    out = margins.fitted_shares(g, "m", "b", [1.5, 1.0, 1.0, 1.0, 1.0])
    assert plan(out).count("[1.5,1.0,1.0,1.0,1.0]") == 2  # one in the shares, one in the column of weights
    got = {r["bucket"]: (r["observed"], r["fitted"]) for r in out.collect()}
    assert got[0][0] == 0.5 and math.isclose(got[0][1], (0.3 / 1.1 + 0.15 / 1.05) / 2)
